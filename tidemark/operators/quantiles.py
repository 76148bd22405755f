"""Exact quantiles without gathering a group into one task.

Spark's exact ``percentile`` / ``median`` aggregates merge every distinct
value of a group into one buffer, so a global quantile (or a date holding a
third of all rows) lands whole in one task.  ``exact_quantiles`` gives the same
answer (linear interpolation between the order statistics at floor/ceil of
q·(n−1)) by radix selection on the order-preserving 64-bit pattern of the
double: every round is a partial aggregate of at most 1,024 bucket counts and
fixes ten more bits, so seven rounds end in single values for any data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: Right shifts that leave the leading 10, 20, ... 60 and at last all 64 bits.
SHIFTS = (54, 44, 34, 24, 14, 4, 0)


def ordered_bits(x: Column) -> Column:
    """Bigint that orders like the double: its bit pattern, with the magnitude bits
    of negative numbers flipped (-0.0 counts as 0.0)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x + F.lit(0.0)).cast("bigint")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def exact_quantiles(df: DataFrame, value: str, probs: list[float], group_cols=()) -> DataFrame:
    """Per group and probability: the exact quantile of the non-null,
    non-NaN values of ``value``.  Output: group columns, ``prob``, ``quantile``
    (groups without values are absent).

    Each target order statistic keeps the leading bits known to be its own and
    the count of values below them.  A round joins the rows to the (small)
    table of open targets on the group keys, counts the rows with the same
    leading bits by the next ten (partial aggregation: a hot group costs one row
    per bucket per map task) and keeps the bucket that holds the rank.  A bucket
    with one distinct value is final.  The (group, value) pairs are
    checkpointed once and the small state table each round, into the shared
    folder."""
    groups = list(group_cols) or ["_all"]
    src = df if group_cols else df.withColumn("_all", F.lit(0))
    x = F.col(value).cast("double")
    data = cut_lineage(src.select(*groups, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan(F.col("_x")))
                       .withColumn("_k", ordered_bits(F.col("_x"))))
    qs = F.array(*[F.lit(float(q)) for q in probs])
    targets = cut_lineage(
        data.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
        .select(*groups, "_n", F.posexplode(qs).alias("_i", "_q"))
        .withColumn("_h", F.col("_q") * (F.col("_n") - 1)))
    state = (targets.select(*groups, F.explode(F.array(F.floor("_h"), F.ceil("_h"))).alias("_r")).distinct()
             .withColumn("_below", F.lit(0).cast("bigint")))
    found = []
    for at, shift in enumerate(SHIFTS):
        rows = data.join(state, groups)
        if at:
            rows = rows.filter(F.shiftright("_k", SHIFTS[at - 1]) == F.col("_p"))
        hist = (rows.groupBy(*groups, "_r", "_below", F.shiftright("_k", shift).alias("_b"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")))
        w = Window.partitionBy(*groups, "_r").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("_before", F.col("_below") + F.sum("_c").over(w) - F.col("_c"))
        hit = cut_lineage(
            hist.filter((F.col("_before") <= F.col("_r")) & (F.col("_r") < F.col("_before") + F.col("_c")))
            .select(*groups, "_r", F.col("_before").alias("_below"), F.col("_b").alias("_p"), "_lo", "_hi"))
        found.append(hit.filter(F.col("_lo") == F.col("_hi")).select(*groups, "_r", F.col("_lo").alias("_v")))
        state = hit.filter(F.col("_lo") < F.col("_hi")).drop("_lo", "_hi")
        if state.isEmpty():
            break
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    lo_v = values.select(*groups, F.col("_r").alias("_rf"), F.col("_v").alias("_vf"))
    hi_v = values.select(*groups, F.col("_r").alias("_rc"), F.col("_v").alias("_vc"))
    out = (targets.withColumn("_rf", F.floor("_h")).withColumn("_rc", F.ceil("_h"))
           .join(lo_v, [*groups, "_rf"]).join(hi_v, [*groups, "_rc"]))
    # Spark's interpolation form (stays exact for equal ends and infinities)
    q = F.when((F.col("_rf") == F.col("_rc")) | (F.col("_vf") == F.col("_vc")), F.col("_vf")).otherwise(
        (F.col("_rc") - F.col("_h")) * F.col("_vf") + (F.col("_h") - F.col("_rf")) * F.col("_vc"))
    res = out.select(*groups, F.col("_q").alias("prob"), q.alias("quantile"))
    return res.drop("_all") if not group_cols else res
