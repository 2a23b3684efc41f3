"""Sketches that merge: distinct counts and quantiles kept by group, small whatever the rows, put together for any set of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: lgK of the distinct-count sketches (relative error about 1.04 / sqrt(2**lgK) once, thrice that hardly ever) and k of the quantile ones (error of rank under 1.4 % at 200, with a chance of 99 %).
DISTINCT_BITS, QUANTILE_SIZE = 12, 400


def sketched(rows: DataFrame, by: list[str], distinct: dict[str, Column], quantiles: dict[str, Column]) -> DataFrame:
    """by, n, a distinct-count sketch for each name in distinct, a quantile sketch for each in quantiles. Nulls don't count; a group without any values has a null quantile sketch."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        *[F.hll_sketch_agg(c, F.lit(DISTINCT_BITS)).alias(n) for n, c in distinct.items()],
        *[F.kll_sketch_agg_double(c.cast("double"), F.lit(QUANTILE_SIZE)).alias(n) for n, c in quantiles.items()],
    )


def merged(sketches: DataFrame, by: list[str], distinct: list[str], quantiles: list[str]) -> DataFrame:
    """Sketches of finer groups as sketches of the groups in by: the same as if the rows had been sketched so, but for what quantile sketches draw."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), *[F.hll_union_agg(c).alias(c) for c in distinct], *[F.kll_merge_agg_double(c).alias(c) for c in quantiles])


def distinct_count(sketch: Column) -> Column:
    """The same for a sketch of rows and for sketches put together: a union, here with itself, leaves what is estimated from the order of rows out of it."""
    return F.hll_sketch_estimate(F.hll_union(sketch, sketch))


def quantile(sketch: Column, rank: float) -> Column:
    """The value at a rank from 0 to 1."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(rank))


def rank_of(sketch: Column, value: float) -> Column:
    """The share of values at most so large."""
    return F.kll_sketch_get_rank_double(sketch, F.lit(float(value)))
