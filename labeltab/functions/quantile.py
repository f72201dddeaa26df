"""Exact quantiles by repeated histograms (linear interpolation, as pandas / SQL
``quantile_cont``).

Every wanted rank of a (group, feature) has a bracket of values that holds it, at first from the
smallest to the largest value. A pass counts the rows of each open bracket in ``BINS`` bins (a
partial aggregate, so a hot group is spread) and shrinks the bracket to the smallest and largest
value of the bin with the rank, until both agree. Bins are computed from the value alone, never
from a physical partition. The first pass bins on a logarithmic scale, the others on a linear
one, and the two ends of a bracket always have bins of their own, so every pass shrinks it;
doubles take at most about seven. Brackets are written to the shared folder between passes.
One path serves every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltab.functions.exprs import clean_number
from labeltab.session import scratch_path

BINS = 4096


def long_values(df: DataFrame, groups: Sequence[str], features: Sequence[str]) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), (clean_number(f, df.schema[f].dataType) + F.lit(0.0)).alias("v"))
                    for f in features])
    return df.select(*groups, F.inline(arr)).where(F.col("v").isNotNull())


def _written(df: DataFrame) -> DataFrame:
    path = scratch_path(df.sparkSession, "quantiles")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _log(x: Column) -> Column:
    top = F.lit(1.7976931348623157e308)
    return F.signum(x) * F.log1p(F.least(F.abs(x), top))


def exact_quantiles(df: DataFrame, groups: Sequence[str], features: Sequence[str], probs: Sequence[float],
                    overall_label: str | None = None) -> DataFrame:
    """(groups..., feature, p, q) for every group, feature and probability. With
    ``overall_label`` (one string group column) the all-rows quantiles are added under it."""
    groups = list(groups)
    keys = [*groups, "feature"]
    vals = long_values(df, groups, features)
    if overall_label is not None:
        vals = vals.withColumn(groups[0], F.explode(F.array(F.col(groups[0]), F.lit(overall_label))))
    base = _written(vals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    pos = F.col("p") * (F.col("n") - 1)
    wanted = (base.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).withColumn("pos", pos)
              .withColumn("r_lo", F.floor("pos")).withColumn("r_hi", F.ceil("pos")))
    state = _written(wanted.select(*keys, "lo", "hi", F.lit(0).cast("bigint").alias("before"),
                                   F.explode(F.array("r_lo", "r_hi")).alias("r")).distinct())
    logarithmic = True
    while state.where("lo < hi").limit(1).count():
        open_ = state.where("lo < hi")
        bracket = open_.select(*keys, "lo", "hi").distinct()
        rows = vals.join(bracket, keys).where((F.col("v") >= F.col("lo")) & (F.col("v") <= F.col("hi")))
        v, lo, hi = F.col("v"), F.col("lo"), F.col("hi")
        share = (v / 2 - lo / 2) / F.nullif(hi / 2 - lo / 2, F.lit(0.0))
        if logarithmic:
            share = (_log(v) - _log(lo)) / F.nullif(_log(hi) - _log(lo), F.lit(0.0))
        inner = F.least(F.floor(F.coalesce(F.nanvl(share, F.lit(0.0)), F.lit(0.0)) * BINS), F.lit(BINS - 1))
        place = F.when(v <= lo, 0).when(v >= hi, BINS + 1).otherwise(inner + 1)
        bins = (rows.groupBy(*keys, "lo", "hi", place.alias("bin"))
                .agg(F.count(F.lit(1)).alias("c"), F.min("v").alias("mn"), F.max("v").alias("mx")))
        below = Window.partitionBy(*keys, "lo", "hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        bins = bins.withColumn("cum", F.coalesce(F.sum("c").over(below), F.lit(0)))
        inside = (F.col("r") >= F.col("before") + F.col("cum")) & (F.col("r") < F.col("before") + F.col("cum") + F.col("c"))
        shrunk = (open_.join(bins, [*keys, "lo", "hi"]).where(inside)
                  .select(*keys, F.col("mn").alias("lo"), F.col("mx").alias("hi"),
                          (F.col("before") + F.col("cum")).cast("bigint").alias("before"), "r"))
        state = _written(state.where("lo >= hi").unionByName(shrunk))
        logarithmic = False
    at = state.select(*keys, "r", F.col("lo").alias("x"))
    both = (wanted.drop("lo", "hi").join(at.withColumnsRenamed({"r": "r_lo", "x": "v_lo"}), [*keys, "r_lo"])
            .join(at.withColumnsRenamed({"r": "r_hi", "x": "v_hi"}), [*keys, "r_hi"]))
    q = F.when(F.col("r_hi") == F.col("r_lo"), F.col("v_lo")).otherwise(
        (F.col("r_hi") - F.col("pos")) * F.col("v_lo") + (F.col("pos") - F.col("r_lo")) * F.col("v_hi"))
    return both.select(*keys, "p", q.alias("q"))


def quantile_columns(qdf: DataFrame, keys: Sequence[str], names: dict[float, str]) -> DataFrame:
    """Pivot (keys..., p, q) to one column per probability (names: p -> column)."""
    return qdf.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == float(p), F.col("q"))).alias(n)
                                    for p, n in names.items()])
