"""Long histories in blocks, so that one symbol is the work of many tasks.

A block holds ``size`` consecutive bars of a symbol as its own, and copies of the bars around it that windows of its rows reach. Bars are
numbered without a window over a whole symbol: counts by slabs of days are summed up over the slabs, and a bar's number is its slab's
start plus its place in the slab.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barweave.functions import windows

#: Bars that a block owns, and days of a slab.
SIZE, SLAB_DAYS = 8192, 64


def number(bars: DataFrame, slab_days: int = SLAB_DAYS) -> DataFrame:
    """``bars`` with ``_n``, their place among their symbol's bars by ts, from 0."""
    slab = F.floor(F.unix_date(F.to_date("ts")) / slab_days)
    rows = bars.withColumn("_slab", slab)
    counts = rows.groupBy("symbol", "_slab").agg(F.count("*").alias("_c"))
    before = F.sum("_c").over(Window.partitionBy("symbol").orderBy("_slab").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")
    starts = counts.select(F.col("symbol").alias("_s"), F.col("_slab").alias("_b"), before.alias("_start"))
    joined = rows.join(starts, F.col("symbol").eqNullSafe(F.col("_s")) & F.col("_slab").eqNullSafe(F.col("_b")))
    place = F.row_number().over(Window.partitionBy("symbol", "_slab").orderBy("ts"))
    return joined.withColumn("_n", F.col("_start") + place - 1).drop("_slab", "_s", "_b", "_start")


def in_blocks(numbered: DataFrame, back: int, ahead: int = 0, size: int = SIZE) -> DataFrame:
    """Numbered bars in blocks: ``_block``, and ``_own``, which is false for the copies of the ``back`` bars before a block and the
    ``ahead`` bars after it."""
    n = F.col("_n")
    reach = F.sequence(F.greatest(F.lit(0), F.floor((n - ahead) / size)), F.floor((n + back) / size))
    return numbered.withColumn("_block", F.explode(reach)).withColumn("_own", F.col("_block") == F.floor(n / size))


def rolling(bars: DataFrame, keep: list, columns: dict, back: int, ahead: int = 0, size: int = SIZE) -> DataFrame:
    """``keep`` and window columns over bars, block by block. A column is a function without arguments that builds it from the functions of
    ``windows``; it reaches at most ``back`` bars back and ``ahead`` ahead."""
    rows = in_blocks(number(bars), back, ahead, size)
    with windows.keyed("symbol", "_block"):
        built = [f().alias(name) for name, f in columns.items()]
    return rows.select(*keep, *built, "_own").where("_own").drop("_own")


def rolling_quantiles(bars: DataFrame, wanted: list[tuple[str, int, float, str]], size: int = SIZE) -> DataFrame:
    """``bars`` with a column (name) for each (column, frame, quantile, name): the quantile over the last ``frame`` bars, interpolated between
    neighbours; null until there are as many values. Bars that have their number ``_n`` already keep it. Each block slides a sorted structure over its bars, one step in and one out a row."""
    rows = in_blocks(bars if "_n" in bars.columns else number(bars), max(n for _, n, _, _ in wanted), 0, size)
    schema = T.StructType([*bars.schema, *(T.StructField(name, T.DoubleType()) for *_, name in wanted)])

    def slide(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_n", ignore_index=True)
        for x, n, q, name in wanted:
            frame[name] = frame[x].astype(float).rolling(n, min_periods=n).quantile(q, interpolation="linear")
        return frame.loc[frame["_own"], schema.names]

    return rows.groupBy("symbol", "_block").applyInPandas(slide, schema)


def curve(rows: DataFrame, column: str, keys: tuple[str, ...] = (), slab_days: int = SLAB_DAYS) -> DataFrame:
    """``rows`` with equity (what 1 grows to by the returns in ``column``, in the order of ts; null counts as 0) and drawdown (relative to
    the highest equity so far), for each of ``keys``.

    In two levels: each slab of days is summed up on its own, as its total and its highest prefix; the slabs' totals, a row a slab, are
    composed in order of time; and each row adds what its slab starts with.
    """
    slab = Window.partitionBy(*keys, "_slab").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.withColumn("_slab", F.floor(F.unix_date(F.to_date("ts")) / slab_days)).withColumn("_s", F.sum(F.log1p(F.coalesce(column, F.lit(0.0)))).over(slab))
    parts = parts.withColumn("_top", F.max("_s").over(slab))
    sums = parts.groupBy(*keys, "_slab").agg(F.max_by("_s", "ts").alias("total"), F.max("_s").alias("top"))
    each = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_slab", "total", "top"))).alias("slabs"))
    start = F.struct(F.array().cast("array<struct<_slab:bigint,_sum:double,_peak:double>>").alias("out"), F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("peak"))

    def step(acc, x):
        here = F.struct(x["_slab"].alias("_slab"), acc["sum"].alias("_sum"), acc["peak"].alias("_peak"))
        return F.struct(F.concat(acc["out"], F.array(here)).alias("out"), (acc["sum"] + x["total"]).alias("sum"), F.greatest(acc["peak"], acc["sum"] + x["top"]).alias("peak"))

    starts = each.select(*keys, F.inline(F.aggregate("slabs", start, step, lambda acc: acc["out"])))
    joined = parts.join(starts, [*keys, "_slab"])
    level = F.col("_sum") + F.col("_s")
    fall = level - F.greatest("_peak", F.col("_sum") + F.col("_top"))
    return joined.select(*(joined[c] for c in rows.columns), F.exp(level).alias("equity"), F.expm1(fall).alias("drawdown"))
