"""Unit tables for the semantic traps (pandas / Python behaviour is the spec)."""

import math
import random
from datetime import date, datetime
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as TX
from tidemark.functions.fixed import DEFAULT_LEXICON
from tidemark.operators import aspects as A
from tidemark.operators import filings as FI
from tidemark.operators import news as N
from tidemark.operators import novelty as NV
from tidemark.operators import prices as PR
from tidemark.operators import sentiment as S


def _bars(spark, closes, ticker="T", start=date(2024, 1, 1), volume=100):
    rows = [(ticker, date.fromordinal(start.toordinal() + i), c, c * 1.01, c * 0.99, c, volume)
            for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, "
                                       "close double, volume long")


def test_rolling_needs_full_window_T2(spark):
    closes = [float(10 + (i % 7)) for i in range(30)]
    out = PR.technical_indicators(_bars(spark, closes)).orderBy("date").toPandas()
    ref = pd.Series(closes).rolling(20).mean()
    got = out["sma_20"]
    assert got[:19].isna().all()
    assert np.allclose(got[19:], ref[19:])


def test_rsi_matches_pandas_T3(spark):
    rng = np.random.default_rng(1)
    closes = [float(c) for c in 100 + np.cumsum(rng.normal(size=40))]
    out = PR.technical_indicators(_bars(spark, closes)).orderBy("date").toPandas()
    s = pd.Series(closes)
    delta = s.diff()
    gain = delta.where(delta > 0, 0).rolling(14).mean()
    loss = (-delta.where(delta < 0, 0)).rolling(14).mean()
    rsi = 100 - 100 / (1 + gain / loss)
    assert np.allclose(out["rsi"].astype(float), rsi, equal_nan=True)


def test_flat_window_gives_null_not_error_T3(spark):
    out = PR.technical_indicators(_bars(spark, [5.0] * 25)).orderBy("date").toPandas()
    assert out["bb_position"].isna().all()
    assert out["rsi"].isna().all()


def test_returns_and_volatility_match_pandas(spark):
    rng = np.random.default_rng(3)
    closes = [float(c) for c in 50 + np.cumsum(rng.normal(size=45))]
    out = PR.with_returns(_bars(spark, closes)).orderBy("date").toPandas()
    s = pd.Series(closes)
    r = s.pct_change()
    assert np.allclose(out["return_1d"], r, equal_nan=True)
    assert np.allclose(out["return_1d_fwd"], r.shift(-1), equal_nan=True)
    assert np.allclose(out["volatility_20d"], r.rolling(20).std() * math.sqrt(252), equal_nan=True)


def test_windows_do_not_bleed_across_tickers(spark):
    a = _bars(spark, [1.0, 2.0, 4.0], "A")
    b = _bars(spark, [10.0, 5.0], "B")
    out = {(r.ticker, r.date): r.return_1d for r in PR.with_returns(a.unionByName(b)).collect()}
    assert out[("B", date(2024, 1, 1))] is None
    assert out[("B", date(2024, 1, 2))] == pytest.approx(-0.5)


def test_pct_change_forward_fills_T4(spark):
    df = spark.createDataFrame([("T", date(2024, 1, d), c) for d, c in
                                [(1, 10.0), (2, None), (3, 12.0), (4, 15.0)]], "ticker string, date date, close double")
    out = PR.calculate_returns(df, periods=[1]).orderBy("date").toPandas()
    ref = pd.Series([10.0, None, 12.0, 15.0]).ffill().pct_change()
    assert np.allclose(out["return_1d"], ref, equal_nan=True)


def test_clean_prices_rules(spark):
    rows = [("T", date(2024, 1, 1), 1.0, 2.0, 0.5, 1.5, 10), ("T", date(2024, 1, 2), None, 2.0, 0.5, 1.5, 10),
            ("T", date(2024, 1, 3), 1.0, 0.4, 0.5, 1.5, 10), ("T", date(2024, 1, 4), 1.0, 2.0, 0.5, 1.5, -1),
            ("T", date(2024, 1, 5), 0.0, 2.0, 0.5, 1.5, 10), ("T", date(2024, 1, 6), 1.0, 2.0, 0.5, 1.5, None)]
    df = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, "
                                     "close double, volume long")
    assert [r.date.day for r in PR.clean_prices(df).collect()] == [1]


def _novelty_input(spark, rows):
    return spark.createDataFrame(rows, "ticker string, date date, text string, embedding array<double>")


def test_novelty_rules_T7_T8(spark):
    e1, e2 = [1.0, 0.0], [0.0, 1.0]
    rows = [("A", date(2024, 1, d), "x", e1) for d in range(1, 6)]
    rows += [("A", date(2024, 1, 6), "x", e2),            # orthogonal to history -> 1.0
             ("A", date(2024, 1, 7), "   ", e1),          # blank only -> 0.0
             ("A", date(2024, 1, 8), "x", [-1.0, 0.0]),   # negative cosine clipped -> 1.0
             ("A", date(2024, 1, 9), "x", [0.0, 0.0]),    # zero vector -> cosine 0 -> 1.0
             ("B", date(2024, 1, 6), "x", e1)]            # no history -> 0.5
    fd = NV.firm_day_embedding(_novelty_input(spark, rows), dim=2)
    got = {(r.ticker, r.date.day): (r.novelty_score, r.window_size) for r in NV.novelty(fd).collect()}
    assert got[("A", 5)][0] == 0.5 and got[("A", 5)][1] == 4
    assert got[("A", 6)] == (pytest.approx(1.0), 5)
    assert got[("A", 7)][0] == 0.0
    assert got[("A", 8)][0] == pytest.approx(1.0)
    assert got[("A", 9)][0] == pytest.approx(1.0)
    assert got[("B", 6)][0] == 0.5


def test_novelty_window_edges_T8(spark):
    e = [1.0, 1.0]
    days = [date(2024, 1, 1), date(2024, 1, 2)] + [date(2024, 1, 25 + i) for i in range(4)] + [date(2024, 1, 31)]
    rows = [("A", d, "x", e) for d in days]
    fd = NV.firm_day_embedding(_novelty_input(spark, rows), dim=2)
    got = {r.date: r.window_size for r in NV.novelty(fd).collect()}
    # 2024-01-31: history [01-01, 01-30] -> 01-01 (day -30) counts, same day does not
    assert got[date(2024, 1, 31)] == 6


def test_novelty_scale_invariant_and_bounded(spark):
    rng = np.random.default_rng(5)
    rows = [("A", date(2024, 1, 1 + i), "x", [float(v) for v in rng.normal(size=4)]) for i in range(12)]
    base = NV.novelty(NV.firm_day_embedding(_novelty_input(spark, rows), dim=4))
    scaled_rows = [(t, d, x, [3.0 * v for v in e]) for t, d, x, e in rows]
    scaled = NV.novelty(NV.firm_day_embedding(_novelty_input(spark, scaled_rows), dim=4))
    a = sorted((r.date, r.novelty_score) for r in base.collect())
    b = sorted((r.date, r.novelty_score) for r in scaled.collect())
    for (d1, s1), (d2, s2) in zip(a, b):
        assert d1 == d2 and s1 == pytest.approx(s2) and 0.0 <= s1 <= 1.0


def test_percentile_matches_pandas_rank(spark):
    vals = [0.3, None, 0.1, 0.3, 0.9, 0.1]
    df = spark.createDataFrame([(date(2024, 1, 1), f"T{i}", v) for i, v in enumerate(vals)],
                               "date date, ticker string, novelty_score double")
    out = NV.cross_sectional_novelty(df).orderBy("ticker").toPandas()
    ref = pd.Series(vals).rank(pct=True) * 100
    assert np.allclose(out["novelty_percentile"].astype(float), ref, equal_nan=True)


def test_zero_fill_never_truncates_T9(spark):
    df = spark.createDataFrame([("123",), ("12345678901",)], "c string")
    assert [r[0] for r in df.select(TX.zero_fill(F.col("c"), 10)).collect()] == ["0000000123", "12345678901"]


def test_keyword_substring_semantics_T10(spark):
    df = spark.createDataFrame([(1, "Up against the update"), (2, "A liquidity squeeze")], "id int, text string")
    flags = A.keyword_flags(F.col("text"))
    out = {r.id: r for r in df.select("id", *[v.alias(k) for k, v in flags.items()]).collect()}
    assert out[1]["financial_performance"]          # "gain" inside "against"
    assert out[2]["liquidity"]                       # "liquid*" wildcard
    pol = N.keyword_polarity(df.withColumn("title", F.col("text")).withColumn("summary", F.lit(None)))
    # "up" (also inside "update") counts once; "gains" hides inside "against"
    assert {r.id: r.positive_count for r in pol.collect()}[1] == 2


def test_empty_links_collapse_T11(spark):
    rows = [("", "a", datetime(2024, 1, 1), 1, "s"), ("", "b", datetime(2024, 1, 2), 2, "s"),
            ("x", "c", datetime(2024, 1, 3), 3, "s")]
    df = N.with_url_hash(spark.createDataFrame(rows, "link string, title string, collected_at timestamp, "
                                                     "feed_pos int, source string"))
    out = sorted(r.title for r in N.first_seen(df).collect())
    assert out == ["a", "c"]


def test_cap_per_source_keeps_first_n(spark):
    rows = [(f"u{i}", "s", i) for i in range(120)] + [("v", "t", 0)]
    df = spark.createDataFrame(rows, "url_hash string, source string, feed_pos int")
    out = N.cap_per_source(df, 50)
    assert out.filter("source = 's'").count() == 50
    assert out.filter("source = 's'").agg(F.max("feed_pos")).collect()[0][0] == 49


def test_aspect_vs_sentiment_null_handling_T13_T14(spark):
    df = spark.createDataFrame([("k", {"risk": 0.5}, 1.0), ("k", {}, 3.0)],
                               "key string, aspect_scores map<string,double>, w double")
    asp = A.aggregate_aspects(df, ["key"], how="mean").collect()
    assert asp[0].score == 0.5                       # texts without the aspect are ignored
    sent = spark.createDataFrame([("k", 1.0, None, 0.0, 0.0, 1.0), ("k", 0.0, 0.0, 1.0, 0.0, 1.0)],
                                 "key string, sentiment_positive double, sentiment_negative double, "
                                 "sentiment_neutral double, sentiment_compound double, w double")
    agg = S.aggregate_sentiment(sent, ["key"], "w").collect()[0]
    assert agg.negative == 0.0 and agg.positive == 0.5 and agg.neutral == 0.5
    assert agg.label == "positive"                   # tie -> positive first
    zero = S.aggregate_sentiment(sent.withColumn("w", F.lit(0.0)), ["key"], "w").collect()[0]
    assert zero.positive is None


def test_time_series_sum_and_null_dates_T15(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), None), (date(2024, 1, 1), None), (None, 1.0),
                                (date(2024, 1, 2), 2.0)], "d date, v double")
    out = {r.d: r.v for r in S.sentiment_time_series(df, "d", "v", "sum").collect()}
    assert out == {date(2024, 1, 1): 0.0, date(2024, 1, 2): 2.0}


def test_html_text_nodes_joined_without_separator_T16(spark):
    html = ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head>"
            "<body><p>a<b>b</b></p><table><tr><td>x</td></tr></table><!-- c -->"
            "<p>&amp;&lt;x&gt; &quot;q&quot;  end</p></body></html>")
    df = spark.createDataFrame([(html,)], "html string")
    assert FI.clean_html(df, "html").collect()[0].text == 'Tab&<x> "q" end'


def test_html_tables_at_any_depth_and_every_reference(spark):
    cases = [("a<table>OUT<table>IN</table>ER</table>b&#160;c&#8217;s &eacute;&copy &#x1F600;", "ab c’s é© 😀"),
             ("x</table>y<TABLE\n z>q", "xy"), ("&amp;lt; &#0; &#xD800; &unknown; &AMP", "&lt; � � &unknown; &"),
             ("<tablet>kept</tablet> a < b", "kept a < b"), ("", ""), (None, None),
             ("<table>" * 40 + "deep" + "</table>" * 40 + "out", "out"), ("1<b>2</b>3<script>if(a<table)</script>4", "1234")]
    df = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {r.i: r.text for r in FI.clean_html(df, "html").collect()}
    assert got == {i: t for i, (_, t) in enumerate(cases)}
    low = spark.createDataFrame([("A <Table>x<table>y</table>z</table>B Exhibit 99.1 c",)], "t string")
    assert low.select(FI.strip_exhibits(F.col("t")).alias("t")).collect()[0].t == "a b c"


class _Page(HTMLParser):
    """Text of a page by the standard parser, without scripts, styles and tables."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.raw, self.depth = [], None, 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.raw = tag
        elif tag == "table":
            self.depth += 1

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_endtag(self, tag):
        if tag == self.raw:
            self.raw = None
        elif tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if not self.raw and not self.depth:
            self.out.append(data)

    @classmethod
    def text(cls, page):
        parser = cls()
        parser.feed(page)
        parser.close()
        return " ".join("".join(parser.out).split())


def test_html_equals_the_standard_parser(spark):
    rng = random.Random(4)
    bits = ["a", "b ", "<b>", "</b>", "<i title='x>y'>", "<p class=\"q'>\">", "<table>", "<TABLE x=1>", "</table>",
            "<!-- c -->", "<!-- <script> -->", "<script>", "</script>", "<style>p{}</style>", "&amp;", "&lt;", "&#146;",
            "&copyfoo", "&copy;", "&", "<", ">", "&#x41;", "<br/>", "<table/>", "=", "it's", "<p title=it's>", "\"",
            "<!DOCTYPE x>", "<?pi?>", "</>", "&notin;", "&notit;", "1 < 2", "<tablet>", "</tablet>", "\n", "&#0;", "&#1;",
            "&#xD800;", "&#150", "&zzz;", "&#;", "&AMP", " "]
    pages = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(3000)]
    pages += ["Company&#146;s &#147;plan&#148; &#150; &copyfoo", "<!-- <script> -->keep</script>", "a<b foo", "<p>one<p>two",
              "<![CDATA[x<b>y]]>z", "<script src=x />z</script>w"]
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    got = {r.i: r.text for r in FI.clean_html(df, "html").collect()}
    assert got == {i: _Page.text(p) for i, p in enumerate(pages)}


def test_every_reference_equals_the_standard_decoder(spark):
    rng = random.Random(6)
    refs = [f"&#{n};" for n in [*range(300), 0xFDD0, 0xFFFE, 0xFFFF, 0x1FFFE, 0x10FFFF, 0x110000, 0xD800, 99999999999]]
    refs += [f"&{n}{tail}" for n in html5 for tail in ("", "x", " ")]
    refs += ["&" + "".join(rng.choices("abcdefglmnopqrstABx#0123456789;&", k=rng.randrange(1, 9))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(refs)), "i int, t string")
    got = {r.i: r.t for r in df.select("i", FI.decode_entities(F.col("t")).alias("t")).collect()}
    assert got == {i: unescape(r) for i, r in enumerate(refs)}


def test_sections_stop_at_any_item_T17(spark):
    text = ("Cover. Item 2.02 Results were strong, see Item 7 for details. "
            "Item 8.01 Other events. ITEM 2.02 again")
    df = spark.createDataFrame([(1, text)], "id int, text string")
    out = {r.section: r.content for r in FI.sections_long(df, ["id"]).collect()}
    # case-insensitive: the trailing "ITEM 2.02" also ends item 8.01
    assert out == {"item_2_02": "Results were strong, see", "item_8_01": "Other events."}


def test_ticker_mentions_whole_words(spark):
    df = spark.createDataFrame([("AAPL rises; AAPLX no, V and v, MSFT's deal", )], "text string")
    got = df.select(N.ticker_mentions(F.col("text"))).collect()[0][0]
    assert got == ["AAPL", "MSFT", "V"]


def test_collapse_ws_idempotent_and_unicode(spark):
    df = spark.createDataFrame([(" a  b\n\n c\t",)], "t string")
    once = df.select(TX.collapse_ws(F.col("t")).alias("t"))
    twice = once.select(TX.collapse_ws(F.col("t")).alias("t"))
    assert once.collect()[0].t == twice.collect()[0].t == "a b c"


def test_paragraphs_split_on_blank_lines(spark):
    df = spark.createDataFrame([(1, "one\ntwo\n\n \nthree\n\n\n")], "id int, text string")
    out = [(r.paragraph_id, r.paragraph) for r in FI.split_paragraphs(df, "text", ("id",)).collect()]
    assert out == [(0, "one two"), (1, "three")]


def test_token_windows_cover_whole_text(spark):
    words = " ".join(f"w{i}" for i in range(150))
    df = spark.createDataFrame([(1, words)], "id int, text string")
    out = S.token_windows(df, "text", 64, ("id",)).orderBy("window_id").collect()
    assert [r.n_tokens for r in out] == [64, 64, 22]
    assert " ".join(r.window_text for r in out) == words


def test_lexicon_summary_and_overlap(spark):
    summ = {r.aspect: r for r in A.lexicon_summary(spark).collect()}
    assert summ["risk"].n_terms == 7 and summ["risk"].has_vector
    lex = A.lexicon_frame(spark, {"a": ["x", "y", "z"], "b": ["y", "w"]})
    ov = A.lexicon_overlap(lex).collect()[0]
    assert (ov.aspect_a, ov.aspect_b, ov.shared, ov.overlap) == ("a", "b", 1, 0.5)
    default = A.lexicon_overlap(A.lexicon_frame(spark, DEFAULT_LEXICON)).collect()
    assert all(r.overlap <= 0.05 for r in default)


def test_score_sentiment_blank_and_dedupe_agree(spark):
    df = spark.createDataFrame([(1, "Shares rise on upgrade"), (2, "  "), (3, None), (4, "Shares rise on upgrade")],
                               "id int, text string")
    a = {r.id: (r.sentiment_label, r.sentiment_compound) for r in S.score_sentiment(df).collect()}
    b = {r.id: (r.sentiment_label, r.sentiment_compound) for r in S.score_sentiment(df, dedupe=True).collect()}
    assert a == b
    assert a[2] == ("neutral", 0.0) and a[3] == ("neutral", 0.0)
    assert a[1][0] == "positive"


def test_granger_matches_brute_force_lstsq(spark):
    from tidemark.operators import models as M
    rng = np.random.default_rng(5)
    rows = []
    for t in ("A", "B"):
        x = rng.normal(size=50)
        y = np.zeros(50)
        for i in range(1, 50):
            y[i] = 0.3 * y[i - 1] + 0.5 * x[i - 1] + rng.normal()
        rows += [(t, i, float(y[i]), float(x[i])) for i in range(50)]
    df = spark.createDataFrame(rows, "ticker string, date int, y double, x double")
    got = {(r.ticker, r.lag): r for r in M.granger_causality(df, "y", "x", ["ticker"], "date", 3).collect()}
    for t in ("A", "B"):
        ys = np.array([r[2] for r in rows if r[0] == t])
        xs = np.array([r[3] for r in rows if r[0] == t])
        for p in (1, 2, 3):
            yv = ys[p:]
            lags = [np.ones(len(yv))] + [ys[p - i:-i] for i in range(1, p + 1)]
            res = np.column_stack(lags)
            unres = np.column_stack(lags + [xs[p - i:-i] for i in range(1, p + 1)])
            sr = np.sum((yv - res @ np.linalg.lstsq(res, yv, rcond=None)[0]) ** 2)
            su = np.sum((yv - unres @ np.linalg.lstsq(unres, yv, rcond=None)[0]) ** 2)
            g = got[(t, p)]
            assert g.n == len(yv)
            assert np.isclose(g.ssr_restricted, sr) and np.isclose(g.ssr_unrestricted, su)
            assert np.isclose(g.f_stat, (sr - su) / p / (su / (len(yv) - 2 * p - 1)))
        # BIC on the common sample (rows with all 3 lags)
        yc = ys[3:]
        bics = {}
        for p in (1, 2, 3):
            cols = ([np.ones(len(yc))] + [ys[3 - i:-i] for i in range(1, p + 1)]
                    + [xs[3 - i:-i] for i in range(1, p + 1)])
            u = np.column_stack(cols)
            sc = np.sum((yc - u @ np.linalg.lstsq(u, yc, rcond=None)[0]) ** 2)
            bics[p] = len(yc) * np.log(sc / len(yc)) + (2 * p + 1) * np.log(len(yc))
            assert got[(t, p)].n_bic == len(yc) and np.isclose(got[(t, p)].bic, bics[p])
        best = min(bics, key=bics.get)
        assert [p for p in (1, 2, 3) if got[(t, p)].selected] == [best]
    assert np.isclose(M.f_sf(4.102821, 2, 10), 0.05, atol=1e-6)


def test_multi_ols_matches_lstsq(spark):
    from tidemark.operators import models as M
    rng = np.random.default_rng(11)
    x = rng.normal(size=(80, 3))
    y = 0.5 + x @ np.array([1.5, -2.0, 0.25]) + rng.normal(scale=0.1, size=80)
    rows = [(float(a), float(b), None if i % 17 == 0 else float(c), float(t))
            for i, ((a, b, c), t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, y double")
    model = M.fit_ols(df, ["a", "b", "c"], "y")
    keep = [i for i in range(80) if i % 17 != 0]
    design = np.column_stack([np.ones(len(keep)), x[keep]])
    want = np.linalg.lstsq(design, y[keep], rcond=None)[0]
    assert model.n == len(keep)
    assert np.allclose(model.coefficients, want, atol=1e-9)


def test_two_way_fixed_effects_match_dummy_regression(spark):
    """Unbalanced panel: slope equals least squares with entity and time
    dummies; the clustered error equals the formula on the exact two-way
    residuals (Frisch-Waugh-Lovell)."""
    from tidemark.operators import models as M
    rng = np.random.default_rng(4)
    rows = []
    for e, fe in zip("ABCDE", rng.normal(size=5)):
        for t, te in enumerate(rng.normal(size=12)):
            if (ord(e) + t) % 5 == 0:          # holes make it unbalanced
                continue
            x = float(rng.normal())
            rows.append((e, t, float(0.7 * x + fe + te + rng.normal(scale=0.3)), x))
    df = spark.createDataFrame(rows, "ticker string, date int, y double, x double")
    got = M.panel_ols_fe(df, "y", "x", tol=1e-12).collect()[0]
    ents = sorted({r[0] for r in rows})
    times = sorted({r[1] for r in rows})
    dummies = np.array([[1.0 if r[0] == e else 0.0 for e in ents] + [1.0 if r[1] == t else 0.0 for t in times[1:]]
                        for r in rows])
    xv = np.array([r[3] for r in rows])
    yv = np.array([r[2] for r in rows])

    def resid(v):
        return v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]

    xt, yt = resid(xv), resid(yv)
    slope = (xt @ yt) / (xt @ xt)
    full = np.linalg.lstsq(np.column_stack([xv, dummies]), yv, rcond=None)[0]
    assert np.isclose(got.slope, full[0], atol=1e-8) and np.isclose(got.slope, slope, atol=1e-8)
    u = yt - slope * xt
    meat = sum(sum(xt[i] * u[i] for i in range(len(rows)) if rows[i][0] == e) ** 2 for e in ents)
    assert np.isclose(got.cluster_se, np.sqrt(meat) / (xt @ xt), rtol=1e-6)
    assert got.n_obs == len(rows) and got.n_entities == len(ents)


def test_exact_quantiles_equal_spark_percentile(spark):
    """Radix selection gives Spark's exact percentile (linear
    interpolation) for ties, tiny groups, a one-value group and globally."""
    from tidemark.operators.quantiles import exact_quantiles
    rng = np.random.default_rng(0)
    rows = []
    for g, n in (("a", 5000), ("b", 7), ("c", 1), ("d", 3000)):
        vals = rng.normal(size=n) * 10
        if g == "d":
            vals = np.round(vals)                    # heavy ties
        rows += [(g, float(v)) for v in vals]
    rows += [("a", None), ("e", None)]
    rows += [("h", float(s * 10.0 ** e)) for e, s in zip(rng.uniform(-300, 300, 400), rng.choice([-1, 1], 400))]
    rows += [("z", v) for v in (0.0, -0.0, 5e-324, -5e-324)]
    rows += [("f", float(v)) for v in [float("-inf"), -1.0, 2.0, 3.0, float("inf"), float("inf")]]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r.g, r.prob): r.quantile
           for r in exact_quantiles(df, "v", probs, ["g"]).collect()}
    want = {}
    for r in df.groupBy("g").agg(F.percentile("v", probs).alias("p")).collect():
        if r.p is not None:
            want.update({(r.g, q): v for q, v in zip(probs, r.p)})
    assert set(got) == set(want)
    assert all(got[k] == want[k] or np.isclose(got[k], want[k], rtol=0, atol=1e-12) for k in want)
    (glob,) = exact_quantiles(df, "v", [0.5]).collect()
    assert np.isclose(glob.quantile, df.agg(F.median("v")).collect()[0][0], rtol=0, atol=1e-12)


def test_caller_models_plug_in_through_arrow_udfs(spark):
    """UDF-01/02: a caller's sentiment model and encoder run through iterator
    pandas UDFs; blank texts still get the fixed neutral row, and scoring
    distinct texts once (dedupe) gives the same rows."""
    from tidemark.functions.models import pandas_encoder, pandas_scorer
    from tidemark.operators import novelty as NV

    def load_scorer():
        def model(texts):
            out = []
            for t in texts:
                good, bad = t.count("good"), t.count("bad")
                tot = good + bad + 1.0
                out.append({"positive": good / tot, "negative": bad / tot, "neutral": 1 / tot})
            return out
        return model

    def load_encoder():
        return lambda texts: [[float(len(t)), float(t.count(" "))] for t in texts]

    df = spark.createDataFrame([(1, "good good bad"), (2, "bad news"), (3, "  "), (4, "good good bad")],
                               "id int, text string")
    plain = {r.id: r for r in S.score_sentiment(df, "text", scorer=pandas_scorer(load_scorer)).collect()}
    dedup = {r.id: r for r in S.score_sentiment(df, "text", scorer=pandas_scorer(load_scorer),
                                               dedupe=True).collect()}
    assert plain[1].sentiment_label == "positive" and plain[2].sentiment_label == "negative"
    assert (plain[3].sentiment_positive, plain[3].sentiment_neutral) == (0.33, 0.34)   # blank: fixed row
    assert {k: tuple(v) for k, v in plain.items()} == {k: tuple(v) for k, v in dedup.items()}
    enc = {r.id: list(r.embedding) for r in NV.encode(df, "text", encoder=pandas_encoder(load_encoder)).collect()}
    assert enc[1] == [13.0, 2.0] and enc[2] == [8.0, 1.0]


def test_arguments_are_checked_and_passed_on(spark):
    from tidemark.operators import aspects as A
    from tidemark.operators import novelty as NV

    for bad in ({"window_days": 0}, {"min_history": 0}, {"window_days": -3}):
        with pytest.raises(ValueError):
            NV.novelty(spark.createDataFrame([], "ticker string, date date, embedding array<double>"), **bad)
    with pytest.raises(ValueError):
        A.extract_aspects(F.col("t"), {"a": ["x"]}, threshold=1.5)
    df = spark.createDataFrame([("a gain today",), ("gains against it",), ("risky",), ("éGain",)], "t string")
    flags = A.keyword_flags(F.col("t"), {"g": ["gain"], "r": ["risk*"]}, whole_word=True)
    got = [tuple(r) for r in df.select(flags["g"], flags["r"]).collect()]
    assert got == [(True, False), (False, False), (False, True), (False, False)]
    own = S.score_sentiment(df, "t", positive=["today"], negative=["against"])
    assert [r.sentiment_label for r in own.collect()][:2] == [
        r.sentiment_label for r in S.score_sentiment(spark.createDataFrame(
            [("profit",), ("loss",)], "t string"), "t", positive=["profit"], negative=["loss"]).collect()]


def test_a_text_the_model_fails_on_gets_the_neutral_row(spark):
    from tidemark.functions.fixed import NEUTRAL_SCORES
    from tidemark.functions.models import pandas_scorer

    def load():
        def model(texts):
            if any("bad" in t for t in texts):
                raise ValueError("cannot score")
            return [{"positive": 0.7, "negative": 0.1, "neutral": 0.2} for _ in texts]
        return model

    df = spark.createDataFrame([(i, "bad one" if i == 3 else "fine") for i in range(8)], "i int, t string").coalesce(1)
    got = {r.i: r.s.asDict() for r in df.select("i", pandas_scorer(load)(F.col("t")).alias("s")).collect()}
    assert all((got[i]["positive"] == NEUTRAL_SCORES["positive"]) == (i == 3) for i in range(8))
