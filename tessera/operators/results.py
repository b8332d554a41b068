"""Result tables of experiments: sweeps, joins with analyses, group averages, unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The encoder sweep's qualities.
QUALITIES = sorted({*range(0, 101, 10), 25, 75, 85, 95, 96, 97, 97.5, 98, 99})
BAYER_QUALITIES = [q for q in QUALITIES if q != 97.5]


def sweep(files: DataFrame, **lists: list) -> DataFrame:
    """Every file with every combination of the listed values. The lists are literals, so no join is needed: they are exploded in place."""
    for name, values in lists.items():
        files = files.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return files


def with_analysis(results: DataFrame, analysis: DataFrame, left: str = "outfile", right: str = "filename") -> DataFrame:
    """Rows that both tables have; columns of the analysis that clash get the suffix _y."""
    clash = set(results.columns) & set(analysis.columns)
    own = analysis.select(*[F.col(c).alias(c + "_y" if c in clash else c) for c in analysis.columns])
    return results.join(own, results[left] == own[right + "_y" if right in clash else right], "inner")


def averages(df: DataFrame, by: list[str], means: list[str], label: str = "infile", blank: tuple[str, ...] = ()) -> DataFrame:
    """One row a group, labelled `average`, with the means (nulls and NaN left out); other columns are null, `blank` ones empty."""
    clean = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in means])
    out = clean.groupBy(*by).agg(*[F.avg(c).alias(c) for c in means])
    rest = [c for c in df.columns if c not in by and c not in means and c != label and c not in blank]
    kinds = dict(df.dtypes)
    return out.select(*[F.lit("average").alias(c) if c == label else F.lit("").alias(c) if c in blank else F.lit(None).cast(kinds[c]).alias(c) if c in rest else F.col(c) for c in df.columns])


def with_averages(df: DataFrame, by: list[str], means: list[str], label: str = "infile") -> DataFrame:
    """The rows and their averages."""
    wide = df.select(*[F.col(c).cast("double").alias(c) if c in means else F.col(c) for c in df.columns])
    return wide.unionByName(averages(df, by, means, label), allowMissingColumns=True)


def bits_per_pixel(size: str, w: str, h: str) -> Column:
    return F.expr(f"8 * {size} / ({w} * {h})")


def breakdown(values: str, order: str) -> Column:
    """An aggregate: values joined by colons, in order."""
    return F.expr(f"array_join(transform(array_sort(collect_list(struct({order} as o, {values} as v))), s -> cast(s.v as string)), ':')")


def mosaic_round_trip_stats(df: DataFrame, by: list[str], parts: list[str], top: int) -> DataFrame:
    """PSNR of each part against its original (columns part and part_0), 100 where equal."""
    aggs = [F.avg((F.col(p) - F.col(p + "_0")).cast("double") * (F.col(p) - F.col(p + "_0"))).alias(p) for p in parts]
    mse = df.groupBy(*by).agg(*aggs)
    return mse.select(*by, *[F.round(F.when(F.col(p) == 0, 100.0).otherwise(10 * F.log10(F.lit(float(top * top)) / F.when(F.col(p) == 0, None).otherwise(F.col(p)))), 6).alias("psnr_" + p) for p in parts])
