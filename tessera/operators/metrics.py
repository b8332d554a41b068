"""Statistics and quality metrics: aggregations over samples, with partial sums before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Mean and population deviation of each column, to six places."""
    aggs = []
    for c in columns:
        aggs += [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{c}_std")]
    return df.groupBy(*by).agg(*aggs)


def histogram(df: DataFrame, column: str = "v", top: int = 255) -> DataFrame:
    """value, hist, ratio of every value 0..top, zeros too."""
    counts = df.groupBy(F.col(column).cast("int").alias("value")).agg(F.count(F.lit(1)).alias("hist"))
    every = df.sparkSession.range(top + 1).select(F.col("id").cast("int").alias("value")).join(counts, "value", "left").fillna(0, ["hist"])
    total = counts.agg(F.sum("hist").alias("total"))  # one row
    return every.crossJoin(F.broadcast(total)).select("value", "hist", F.round(F.col("hist") / F.col("total"), 9).alias("ratio"))


def mse(df: DataFrame, by: list[str], invert_top: int | None = None, column: str = "v") -> DataFrame:
    """Mean square against zero, or of what is missing to a maximum."""
    x = F.col(column) if invert_top is None else F.lit(invert_top) - F.col(column)
    return df.groupBy(*by).agg(F.round(F.avg((x.cast("long") * x)), 6).alias("mse"))


def psnr_zero(mse_: Column, top: int) -> Column:
    """20 log10(top) - 10 log10(mse), 100 where mse is 0."""
    import math

    return F.when(mse_ <= 0, F.lit(100.0)).otherwise(F.lit(20 * math.log10(top)) - 10 * F.log10(mse_))


def psnr(pairs: DataFrame, by: list[str], top: int = 255, floor_area: bool = False) -> DataFrame:
    """10 log10(top^2 / mse) of a against b. mse 0: infinite, or with floor_area one over the number of samples."""
    d = (F.col("a") - F.col("b")).cast("long")
    out = pairs.groupBy(*by).agg(F.avg(d * d).alias("mse"), F.count(F.lit(1)).alias("n"))
    m = F.when(F.col("mse") == 0, 1.0 / F.col("n")).otherwise(F.col("mse")) if floor_area else F.col("mse")
    value = F.when(m == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(float(top * top)) / F.when(m == 0, None).otherwise(m)))
    return out.select(*by, F.round("mse", 6).alias("mse"), F.round(value, 6).alias("psnr"))


def aepp(pairs: DataFrame, by: list[str]) -> DataFrame:
    return pairs.groupBy(*by).agg(F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("aepp"))


def diff_energy(pairs: DataFrame, by: list[str]) -> DataFrame:
    return stats(pairs.withColumn("diff", F.abs(F.col("a") - F.col("b"))), ["diff"], by)


def bands(df: DataFrame, n: int, height: int) -> DataFrame:
    """Mean and deviation of the middle row of each of n equal bands."""
    rows = height // n
    mid = [(k * rows + (k + 1) * rows - 1) >> 1 for k in range(n)]
    band = F.expr("case y " + " ".join(f"when {m} then {k}" for k, m in enumerate(mid)) + " end")
    return stats(df.filter(F.col("y").isin(mid)).withColumn("band", band), ["v"], ["image_id", "band"])


def ssim(pairs: DataFrame, by: list[str], top: int = 255) -> DataFrame:
    """Structural similarity over one window (Wang et al. 2004)."""
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    out = pairs.groupBy(*by).agg(F.avg(a).alias("ma"), F.avg(b).alias("mb"), F.avg(a * a).alias("aa"), F.avg(b * b).alias("bb"), F.avg(a * b).alias("ab"))
    ma, mb = F.col("ma"), F.col("mb")
    va, vb, cov = F.col("aa") - ma * ma, F.col("bb") - mb * mb, F.col("ab") - ma * mb
    return out.select(*by, F.round(((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2)), 6).alias("ssim"))
