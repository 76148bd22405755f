"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, decontaminate, html_main, language_id, line_dedup, packing, permutation_index, prefix_trie, shingle_join, substring_dedup, token_counts, toxicity, turn_repair
from tidemark.llm.common import crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


@query("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    return language_id.identify(docs, model).select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "evidence")


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op3_html_main_text")
def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract_pages(table(spark, sf_dir, "pages"))


@query("op4_line_dedup")
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


@query("op5_substring_dedup")
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.deduplicate(table(spark, sf_dir, "documents")))


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.components(table(spark, sf_dir, "documents"))


@query("op7_permutation_index")
def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


@query("op8_token_counts")
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                     str(public_tokenizers.path("byte_bpe_50k.json")), limit=512)


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"),
                                 str(public_tokenizers.path("word_bpe_49k.json")), capacity=4096, end_id=1)


@query("op10_decontamination")
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_byte_bpe")
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digest(byte_bpe.decode(encoded, ranks))


#: crc32 of the string ``{0}``, bit by bit (3988292384: the reversed CRC-32 polynomial).
_SQL_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
    lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""


def _repair_sql() -> str:
    """The repair as a recursion from each conversation's last row to its first.  A state's value is
    one string: six digits of cost, the audit, chr(1), the repaired lines; the least string wins."""
    def edit(value: str, cost: str, letter: str, line: str | None = None) -> str:
        rest = f"substr({value}, strpos({value}, chr(1)) + 1)"
        lines = rest if line is None else f"{line} || CASE WHEN {rest} = '' THEN '' ELSE chr(10) || {rest} END"
        return (f"lpad((left({value}, 6)::INT + {cost})::VARCHAR, 6, '0') || '{letter}' || "
                f"substr({value}, 7, strpos({value}, chr(1)) - 7) || chr(1) || {lines}")

    follow, names, initial = {0: 2, 1: 2, 2: 3, 3: 2}, {2: "user", 3: "assistant"}, {2: "u", 3: "a"}
    rows, once, twice = [], [], []
    for s, to in follow.items():
        alive = "CASE WHEN f.fault IN (0, 3) THEN {} ELSE never END"
        keeps = [(initial[to], to)] + ([("s", 1)] if s == 0 else [])
        offers = [edit(f"v{s}", "4", "D"), alive.format(edit(f"v{to}", "3 + dear", "R", f"'{names[to]}:' || f.text"))]
        offers += [f"CASE WHEN f.fault IN (0, 3) AND f.initial = '{c}' THEN {edit(f'v{t}', 'dear', 'K', 'f.role || chr(58) || f.text')} "
                   "ELSE never END" for c, t in keeps]
        rows.append(f"least({', '.join(offers)}) AS x{s}")
        once.append(f"least(x{s}, {edit(f'x{to}', '3', 'I', repr(names[to] + ':'))}) AS y{s}")
        twice.append(f"least(x{s}, {edit(f'y{to}', '3', 'I', repr(names[to] + ':'))}) AS v{s}")
    return f"""
WITH RECURSIVE hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_SQL_CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM hit),
placed AS (
  SELECT *, left(role, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged),
row_fault AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
         coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM placed),
counted AS (
  SELECT conv_id, count(*) AS n_rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE fault = 1) AS blank, count(*) FILTER (WHERE fault = 2) AS duplicate,
         count(*) FILTER (WHERE fault = 3) AS truncated, count(*) FILTER (WHERE illegal) AS illegal
  FROM row_fault GROUP BY conv_id),
step AS (
  SELECT conv_id, n_rows + 1 AS i, '000000' || chr(1) AS v0, '000006II' || chr(1) || 'user:' || chr(10) || 'assistant:' AS v1,
         '000003I' || chr(1) || 'assistant:' AS v2, '000000' || chr(1) AS v3 FROM counted
  UNION ALL
  SELECT conv_id, i, {", ".join(twice)} FROM (
    SELECT *, {", ".join(once)} FROM (
      SELECT s.conv_id, f.n AS i, {", ".join(rows)}
      FROM (SELECT *, '900000' || chr(1) AS never FROM step) s
      JOIN (SELECT *, CASE WHEN fault = 3 THEN 3 ELSE 0 END AS dear FROM row_fault) f
        ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.n = s.i - 1)))
SELECT o.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(left(v0, 6), '0')::BIGINT AS cost,
       coalesce(substr(v0, 7, strpos(v0, chr(1)) - 7), '') AS audit,
       sha256(coalesce(substr(v0, strpos(v0, chr(1)) + 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN (SELECT * FROM step WHERE i = 1) s ON s.conv_id IS NOT DISTINCT FROM o.conv_id
"""


@query("op12_turn_repair", _repair_sql())
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.digest(turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations"))))


@query("op13_prefix_trie", f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, ''))
                       ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns,
         {_SQL_CRC32.format("conv_id::VARCHAR")} % 6 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(d.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
  FROM own c LEFT JOIN own d ON d.conv_id = c.conv_id - c.conv_id % 100),
member AS (
  SELECT conv_id, d, turns[1:d] AS path, len(turns) = d AS ends
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ids,
         (count(*) - 1) * coalesce(length(path[d].x), 0) AS saved
  FROM member GROUP BY path, d),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id
  FROM node n LEFT JOIN node p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]),
family AS (
  SELECT l.*, (SELECT count(*) FROM linked k WHERE k.d = l.d + 1 AND k.parent_conv_id = l.conv_id) AS n_children
  FROM linked l)
SELECT f.conv_id, f.d::BIGINT AS depth, f.parent_conv_id, f.n_convs, f.n_children,
       t.n_leaves, t.saved_tokens, sha256(f.ids) AS ends_sha256
FROM family f JOIN (
  SELECT above.conv_id, above.d, count(*) FILTER (WHERE below.n_children = 0) AS n_leaves,
         sum(below.saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM family) below
  JOIN node above ON above.d = below.up AND above.path = below.path[1:below.up]
  GROUP BY above.conv_id, above.d) t ON t.conv_id = f.conv_id AND t.d = f.d
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.share_heads(prefix_trie.paths(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(rebuilt)
