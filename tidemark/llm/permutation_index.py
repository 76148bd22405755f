"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots; vectors are posted in
the inverted files of those pivots, with the pivot's place in their order.  A
query reads the files of its own nearest pivots, ranks what it finds by the
footrule distance of the two orders (a pivot missing from one of them counts
with the place behind the last), and the closest share of the index is reranked
by the exact inner product.

Nearness is the largest inner product; with one more coordinate
sqrt(longest^2 - norm^2) for indexed vectors (0 for queries) that order is the
order of angles, so vectors of any length are indexed alike.

Fitting takes ``pivots`` vectors, drawn by a hash: a bounded sample.  Every
distinct vector is indexed once: equal vectors form a class that carries its
k + 1 smallest ids, which is all that a list of k neighbours without the query
itself can hold, so a vector that a third of all rows share is one entry.  The
index is cut into shards of about ``SHARD_ROWS`` classes and the queries into
blocks of about ``BLOCK_ROWS``; a task searches one block in one shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

PIVOTS = 512
#: Length of the orders that are kept.
PREFIX = 128
#: Share of a shard that is reranked, and how many vectors at least.
RERANK_SHARE = 0.1
RERANK_LEAST = 1024
SHARD_ROWS = 16_384
BLOCK_ROWS = 8_192


def usable(vector: Column) -> Column:
    """Not null, not empty, only finite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    values = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return values.astype(np.float64).reshape(-1, dim)


class PermutationIndex:
    """Inverted files over the rows of ``vectors``."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, longest: float, prefix: int = PREFIX):
        self.vectors, self.pivots, self.longest = vectors, pivots, longest
        self.prefix = min(prefix, len(pivots))
        order = self._nearest(vectors, np.sqrt(np.maximum(longest ** 2 - (vectors ** 2).sum(1), 0)))
        pivot = order.ravel()
        by_pivot = np.argsort(pivot, kind="stable")
        self.row = np.repeat(np.arange(len(vectors), dtype=np.int32), self.prefix)[by_pivot]
        # a place p of the order is kept as prefix - p: 0 stands for a missing pivot
        self.place = np.tile(np.arange(self.prefix, 0, -1, dtype=np.int16), len(vectors))[by_pivot]
        self.start = np.searchsorted(pivot[by_pivot], np.arange(len(pivots) + 1))

    def _nearest(self, vectors: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """The ``prefix`` nearest pivots of each vector, nearest first."""
        out = np.empty((len(vectors), self.prefix), np.int32)
        for at in range(0, len(vectors), 2048):
            part = slice(at, at + 2048)
            near = -(vectors[part] @ self.pivots[:, :-1].T + extra[part, None] * self.pivots[None, :, -1])
            out[part] = np.argsort(near, axis=1, kind="stable")[:, :self.prefix]
        return out

    def search(self, queries: np.ndarray, k: int, share: float = RERANK_SHARE,
               least: int = RERANK_LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, inner product): the k best of the reranked rows of each query;
        ties go to the earlier row."""
        n = len(self.vectors)
        most = min(n, max(least, k, int(np.ceil(share * n))))
        orders = self._nearest(queries, np.zeros(len(queries)))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for no, order in enumerate(orders):
            # footrule distance = const - 2 * sum over shared pivots of the smaller kept place
            shared = np.zeros(n, np.int32)
            for place, pivot in enumerate(order):
                at = slice(self.start[pivot], self.start[pivot + 1])
                shared[self.row[at]] += np.minimum(self.place[at], self.prefix - place)
            rows = np.arange(n) if most == n else np.sort(np.argsort(-shared, kind="stable")[:most])
            score = self.vectors[rows] @ queries[no]
            best = np.lexsort((rows, -score))[:k]
            found.append((np.full(len(best), no), rows[best], score[best]))
        return tuple(np.concatenate(x) for x in zip(*found))


def nearest(vectors: DataFrame, *, k: int = 20, query_every: int = 20, id_col: str = "vec_id",
            vector_col: str = "embedding", pivots: int = PIVOTS, prefix: int = PREFIX,
            share: float = RERANK_SHARE, least: int = RERANK_LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row whose id is
    divisible by ``query_every``, among all rows but the query's own.

    Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do rows with a null id or vectors of another length than most rows
    have (ties: the shorter).  Rows with equal vectors are all found; a repeated id
    counts once with each of its vectors.  Other columns are ignored; an empty
    table gives no rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"),
                          F.col(vector_col).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & usable(F.col("vector")))
    sizes = rows.groupBy(F.size("vector").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("longest")).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    top = max(sizes, key=lambda r: (r["n"], -r["dim"]))
    dim, longest = top["dim"], float(top["longest"])
    rows = rows.where(F.size("vector") == dim)

    first = Window.partitionBy("vector").orderBy("vec_id")
    classes = cut_lineage(
        rows.distinct().withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= k + 1)
        .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))     # k + 1 at most
        .select(F.col("ids")[0].alias("rep"), "vector", "ids"))
    queries = rows.where(F.col("vec_id") % query_every == 0)
    asked = queries.select("vector").distinct().join(classes.select("rep", "vector"), "vector")

    drawn = classes.orderBy(F.xxhash64("vector"), "vector").limit(pivots).collect()
    p = np.array([r["vector"] for r in drawn], np.float64)
    p = np.c_[p, np.sqrt(np.maximum(longest ** 2 - (p ** 2).sum(1), 0))]
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(p)

    shards = max(1, -(-classes.count() // SHARD_ROWS))
    blocks = max(1, -(-asked.count() // BLOCK_ROWS))
    index = (classes.select("rep", "vector", F.pmod(F.xxhash64("rep"), F.lit(shards)).alias("shard"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    wanted = (asked.select(F.col("rep").alias("query"), "vector",
                           F.pmod(F.xxhash64("rep", F.lit(1)), F.lit(blocks)).cast("int").alias("block"))
              .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shards - 1).cast("bigint")))))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            q, r, s = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            return pa.table({"query": q, "rep": r, "score": s})
        left, right = left.sort_by("rep"), right.sort_by("query")
        found = PermutationIndex(_matrix(left.column("vector"), dim), shared.value, longest, prefix)
        q, r, s = found.search(_matrix(right.column("vector"), dim), k + 1, share, least)
        return pa.table({"query": right.column("query").to_numpy()[q], "rep": left.column("rep").to_numpy()[r],
                         "score": s})

    hits = index.groupBy("shard", "block").cogroup(wanted.groupBy("shard", "block")).applyInArrow(
        search, "query bigint, rep bigint, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    members = (hits.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k + 1)
               .join(classes.select("rep", "ids"), "rep")
               .select("query", "score", F.explode("ids").alias("vec_id")))
    # at most (k + 1)^2 rows of a query
    lists = members.groupBy("query").agg(F.slice(F.sort_array(F.collect_list(
        F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("near"))
    named = asked.select("vector", F.col("rep").alias("query")).join(lists, "query").select("vector", "near")
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    return (queries.distinct().join(named, "vector")
            .select(F.col("vec_id").alias("query_id"), F.posexplode(own).alias("_pos", "_n"))
            .select("query_id", (F.col("_pos") + 1).cast("int").alias("rank"), F.col("_n.vec_id").alias("vec_id"),
                    (-F.col("_n.far")).alias("score")))
