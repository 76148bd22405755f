"""Line deduplication by an exact set-similarity join; DataFrame functions only.

A line is the set of its lower-cased words.  It is removed if an earlier line (smaller
document id, or earlier in the same document) has a set whose Jaccard similarity
reaches the threshold, whether or not that line is itself removed.

1. Words are ordered by rarity: their frequency over the whole corpus, counted in
   ``BUCKETS`` hash buckets (a table of fixed size, so the order is the same in every
   task), then by hash.
2. Lines with equal sets form a class; all but its first line are removed.  Copies
   are counted by partial aggregates, so a line in a third of all documents is one class.
3. Two classes can only match if they share a word among their rarest words.  Each
   class posts that prefix once; the join keeps pairs that pass the length and positional
   filters and whose ``SIGNED`` rarest words do not already lack too many of each other.
   Where a word is posted more than ``BUSY`` times, all its classes first meet the
   ``PIVOTS`` earliest of them alone; a family of near copies mostly matches one of these, and only
   lines that do not go on to the join with all.
4. One match is enough to remove a line, so a round takes each open line's earliest
   untried candidates only, ``WIDER`` at first and ``WIDER`` times as many in each next round.
   The lines are fetched from the texts and compared word by word, the earliest candidate
   first, the others of the round for lines that did not match; a line that matched
   or has no candidate left is settled.  So many near copies of one line cost a pair each.

Words are told apart by 56 bits of their hash within a rarity rank until they are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, free_finished

#: Jaccard threshold as a ratio of integers, so that the comparison is exact.
OVER, UNDER = 9, 10
#: Lines with fewer words, that is blank ones, are kept and match nothing.
MIN_WORDS = 1
BUCKETS = 1 << 16
#: Sets of this size or less match only if they are equal, below the threshold's resolution.
ONLY_EQUAL = OVER - 1

#: Rarest words of a set that its 64-bit signature covers, or its whole prefix if that is longer.
SIGNED = 32
#: Candidates that a line may try in the first round, and growth of that number from round to round.
WIDER = 8
#: Postings of a word from which on its earliest ones, so many, are tried before all others.
BUSY, PIVOTS = 16, 8
#: Line numbers of the texts to compare are broadcast up to this size, so that no text is shuffled for
#: them; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20

_BLANK = r"^[\x20\x09-\x0D]*+\z"


def lines_of(text: Column) -> Column:
    """The lines of a text; null: none."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def is_blank(line: Column) -> Column:
    return line.rlike(_BLANK)


def line_words(line: Column) -> Column:
    """The words of a lower-cased line, as ``common.words`` has them; a line holds no line feed,
    and one plain separator is cheaper to split at than a pattern."""
    for other in "\t\x0b\x0c\r":
        line = F.replace(line, F.lit(other), F.lit(" "))
    return F.array_remove(F.split(F.lower(line), " "), "")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def rarity_ranks(docs: DataFrame) -> bytes:
    """Rank (1 to 127, rising with frequency) of each hash bucket of words."""
    counted = (docs.select(F.explode(line_words(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")))).alias("w"))
               .groupBy(_bucket(F.xxhash64("w")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    ranks = bytearray(b"\x01" * BUCKETS)
    for r in counted.collect():                     # at most BUCKETS rows
        ranks[r["bucket"]] = min(127, 1 + int(3 * math.log2(r["n"])))
    return bytes(ranks)


def word_keys(line: Column, ranks: bytes) -> Column:
    """The distinct words of a line as sorted 63-bit keys, rarest first: rank, then hash."""
    table = F.lit(ranks)
    hashed = F.array_distinct(F.transform(line_words(line), lambda w: F.xxhash64(w)))
    key = F.transform(hashed, lambda h: F.shiftleft(
        F.ascii(F.substring(table, _bucket(h) + 1, F.lit(1)).cast("string")).cast("bigint"), 56).bitwiseOR(
        F.shiftrightunsigned(h, 8)))
    return F.array_distinct(F.sort_array(key))


def _prefix(n: Column) -> Column:
    return n - F.ceil(n * OVER / UNDER).cast("int") + 1


def _numbered_lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(lines_of(F.col("text"))).alias("no", "line")).where(~is_blank(F.col("line")))


def _bits(words: Column) -> Column:
    """64-bit signature of the shortened keys of words."""
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda bits, w: bits.bitwiseOR(
        F.call_function("shiftleft", F.lit(1).cast("bigint"), w.bitwiseAND(63))))


def _postings(classes: DataFrame) -> DataFrame:
    return classes.where(F.col("n") > ONLY_EQUAL).select(
        "doc", "no", "n", "bits", "last", F.posexplode("prefix").alias("at", "word"))


def _met(x: DataFrame, y: DataFrame) -> DataFrame:
    """(doc, no, other_doc, other_no), repeated for every common word: postings ``x`` with those
    of ``y`` that are earlier and pass the filters.

    ``rest`` is what two sets can still share from a common word on.  Of the two runs of
    signed words, the one that ends earlier lies whole within the order range of the other:
    its words that the other's signature lacks are not in the other set at all."""
    x, y = x.alias("x"), y.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    lacks = F.when(F.col("x.last") <= F.col("y.last"),
                   F.col("x.n") - F.bit_count(F.col("x.bits").bitwiseAND(F.bitwise_not("y.bits")))).otherwise(
        F.col("y.n") - F.bit_count(F.col("y.bits").bitwiseAND(F.bitwise_not("x.bits"))))
    lengths = F.least("x.n", "y.n") * UNDER >= F.greatest("x.n", "y.n") * OVER
    enough = F.least(rest, lacks) * (OVER + UNDER) >= (F.col("x.n") + F.col("y.n")) * OVER
    earlier = (F.col("y.doc") < F.col("x.doc")) | ((F.col("y.doc") == F.col("x.doc")) & (F.col("y.no") < F.col("x.no")))
    return x.join(y, (F.col("x.word") == F.col("y.word")) & earlier & lengths & enough).select(
        F.col("x.doc").alias("doc"), F.col("x.no").alias("no"), F.col("y.doc").alias("other_doc"),
        F.col("y.no").alias("other_no"))


def pivot_pairs(classes: DataFrame) -> DataFrame:
    """(doc, no, other_doc, other_no, nth): the classes of each busy word with its earliest ones, at
    most ``PIVOTS`` rows a posting; numbered from 1 for each class."""
    postings = _postings(classes)
    # cut off, so that the join below is dealt out by an exchange of its own and a hot word is split
    busy = cut_lineage(postings.groupBy("word").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > BUSY)
                       .select("word"))
    first = Window.partitionBy("word").orderBy("doc", "no")
    pivots = cut_lineage(postings.join(busy, "word", "left_semi").withColumn("nth", F.row_number().over(first)).where(
        F.col("nth") <= PIVOTS).drop("nth"))
    order = Window.partitionBy("doc", "no").orderBy("other_doc", "other_no")
    return _met(postings, pivots).distinct().withColumn("nth", F.row_number().over(order))


def candidate_pairs(classes: DataFrame, opened: DataFrame | None, most: int, settled: DataFrame) -> DataFrame:
    """(doc, no, other_doc, other_no, nth): of each open class the ``most`` earliest classes before
    it that pass the filters and come after the last one tried, numbered from 1.

    ``opened`` has (doc, no, tried_doc, tried_no); None: every class but those in ``settled``
    (doc, no) is open and untried."""
    key = ["doc", "no"]
    met = _met(_postings(classes.join(settled, key, "left_anti") if opened is None else
                         classes.join(opened.select(*key), key, "left_semi")), _postings(classes))
    if opened is not None:
        met = met.join(opened, key).where(
            F.struct("other_doc", "other_no") > F.struct("tried_doc", "tried_no")).drop("tried_doc", "tried_no")
    order = Window.partitionBy(*key).orderBy("other_doc", "other_no")
    return met.withColumn("nth", F.dense_rank().over(order)).where(F.col("nth") <= most).distinct()


def _matched(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, no): the lines whose words reach the threshold with a partner's."""
    ends = pairs.select("doc", "no").union(pairs.select("other_doc", "other_no"))
    wanted = cut_lineage(ends.groupBy("doc").agg(F.collect_set("no").alias("wanted")))     # lines of one document
    size = wanted.agg(F.sum(F.size("wanted") * 8 + 32)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        wanted = F.broadcast(wanted)
    at = F.transform("wanted", lambda no: F.struct(no.alias("no"), F.get("all", no).alias("line")))
    lines = (docs.join(wanted, F.col("doc_id") == F.col("doc"))
             .select("doc", "wanted", lines_of(F.col("text")).alias("all"))
             .select("doc", F.inline(at)).where("line is not null"))
    one = lines
    two = lines.toDF("other_doc", "other_no", "other_line")
    a, b = (F.array_distinct(line_words(F.col(c))) for c in ("line", "other_line"))
    sets = pairs.join(two, ["other_doc", "other_no"]).join(one, ["doc", "no"]).select("doc", "no", a.alias("a"), b.alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return sets.where(shared * (UNDER + OVER) >= (F.size("a") + F.size("b")) * OVER).select("doc", "no").distinct()


def _settled(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(doc, no): the lines that match a partner: the first is tried before the others of the round."""
    at_once = cut_lineage(_matched(docs, pairs.where("nth = 1")))
    others = pairs.where("nth > 1").join(at_once, ["doc", "no"], "left_anti")
    return at_once.union(cut_lineage(_matched(docs, others)))


def kept_lines(docs: DataFrame) -> DataFrame:
    """(doc, lines): the numbers of the lines of ``docs`` (doc_id, text; ids not null) that
    stay, apart from blank ones, which always do."""
    ranks = rarity_ranks(docs)
    keyed = _numbered_lines(docs).select("doc_id", "no", word_keys(F.col("line"), ranks).alias("keys"))
    n = F.size("keys")
    short = keyed.select("doc_id", "no", "keys", F.transform(
        F.slice("keys", F.lit(1), F.greatest(_prefix(n), F.lit(SIGNED))), lambda k: F.shiftright(k, 32).cast("int")).alias("signed"))
    sets = short.select(
        "doc_id", "no", F.xxhash64(F.lit(1), "keys").alias("k1"), F.xxhash64(F.lit(2), "keys").alias("k2"), n.alias("n"),
        _bits(F.col("signed")).alias("bits"), F.element_at("signed", -1).alias("last"),
        F.slice("signed", F.lit(1), _prefix(n)).alias("prefix"))
    classes = cut_lineage(
        sets.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "no")).alias("first"),
                                     *[F.first(c).alias(c) for c in ("n", "bits", "last", "prefix")])
        .select(F.col("first.doc_id").alias("doc"), F.col("first.no").alias("no"), "n", "bits", "last", "prefix"))

    free_finished(docs.sparkSession)
    gone = by_pivot = _settled(docs, cut_lineage(pivot_pairs(classes)))
    opened, most = None, WIDER
    while True:
        free_finished(docs.sparkSession)
        pairs = cut_lineage(candidate_pairs(classes, opened, most, by_pivot))
        if pairs.isEmpty():
            break
        matched = _settled(docs, pairs)
        gone = gone.union(matched)
        last = pairs.where(F.col("nth") == most).select(
            "doc", "no", F.col("other_doc").alias("tried_doc"), F.col("other_no").alias("tried_no"))
        opened = cut_lineage(last.join(matched, ["doc", "no"], "left_anti"))
        if opened.isEmpty():
            break
        most *= WIDER
    return classes.select("doc", "no").join(gone, ["doc", "no"], "left_anti").groupBy("doc").agg(
        F.collect_list("no").alias("lines"))                                       # lines of one document


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the removed lines cut out of the text, plus
    ``_lines`` and ``_removed`` (how many there were, how many went).

    Blank lines stay, lines of any other length take part; a text left without
    lines is empty; null and empty texts stay as they are.  Rows with a null id neither
    lose lines nor make others lose them.  Ids are expected to be unique: rows that
    repeat an id lose the lines that the first of equal lines under that id does not keep.  Extra
    columns of any name come through, but for ``_lines`` and ``_removed``, which are the
    counts and replace columns of that name; an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where(
        "doc_id is not null")
    kept = kept_lines(rows).toDF("_0", "_1").hint("shuffle_hash")       # line numbers are small beside texts: these are not sorted
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text = F.col(names[text_col])
    split = docs.toDF(*names.values()).join(kept, F.col(names[id_col]).cast("bigint") == F.col("_0"), "left").select(
        *names.values(), "_1", F.split(text, "\n").alias("_2"))
    numbers = F.transform("_2", lambda line, no: F.when(is_blank(line), no))
    nothing = F.array().cast("array<int>")
    stay = F.array_sort(F.array_distinct(F.concat(F.coalesce("_1", nothing), F.array_compact(numbers))))
    left = split.select(*names.values(), "_2", F.when(F.col(names[id_col]).isNull(), F.col("_2")).otherwise(
        F.array_compact(F.transform(stay, lambda no: F.get("_2", no)))).alias("_3"))
    return left.select(
        *[(F.array_join("_3", "\n") if c == text_col else F.col(n)).alias(c) for c, n in names.items()
          if c not in ("_lines", "_removed")],
        F.coalesce(F.size("_2"), F.lit(0)).alias("_lines"),
        F.coalesce(F.size("_2") - F.size("_3"), F.lit(0)).alias("_removed"))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_sha256) for every row; null text: null digest."""
    return deduplicate(docs.select("doc_id", "text")).select(
        "doc_id", F.col("_lines").cast("bigint").alias("n_lines"), F.col("_removed").cast("bigint").alias("n_removed"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"))
