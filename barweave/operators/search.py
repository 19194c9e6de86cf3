"""A search for configurations whose whole state is one table, a folder a generation.

A generation is a population of configurations and what a sweep found of each, written once. All that the search reports or needs to go
on is a query over the generations that are there: elites, hall of fame, suspects, progress, and the next population, whose random draws
are hashes of the seed, the generation and the parent. So a search that lost its driver goes on from the last whole generation, and
repeats exactly. A population has a few dozen rows; the driver reads it only to build its rules as columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barweave.operators import audit, evaluate, stances
from barweave.operators.folds import EMAS, with_folds

# Fixed values of the search.
HORIZONS, SUSPECT, PATIENCE, BETTER, ELITE, HALL, IMMIGRANTS, CHILDREN = (3, 5, 10, 20), 0.80, 2, 0.05, 8, 12, 4, 2
SPREAD = (0.7, 1.4)
# Between what a parameter of a family may lie after a change; others between 2 and 500, or 0.01 and 500.
BOUNDS = {
    "rsi_reversion": {"low": (2, 45), "high": (55, 98), "period": (3, 50)}, "rsi_pro_trend": {"mid": (40, 70)}, "rsi_ma_vol": {"dip": (5, 49), "mid": (50, 95), "n": (20, 400), "vol_mult": (0.5, 5.0), "period": (3, 50)},
    "tri_ma_vol": {"vol_mult": (0.5, 5.0)}, "boll_reversion": {"num_std": (0.5, 4.0)}, "ret_z_fade": {"k": (0.5, 4.0)}, "gap_fade": {"k": (0.5, 4.0)}, "ensemble": {"k": (2, 5)},
    "adaptive_rsi": {"q_low": (0.01, 0.45), "q_high": (0.55, 0.99)}, "range_fade": {"low": (0.01, 0.45), "high": (0.55, 0.99)}, "overnight": {"n": (2, 60)},
    "turn_of_month": {"before": (1, 5), "after": (1, 5)}, "low_vol_reversal": {"n": (1, 30), "vol_window": (5, 120), "vol_mult": (0.3, 1.5)}, "near_52w": {"n": (60, 400), "band": (0.005, 0.15)},
}
# Parameters that must rise.
RISING = {
    "ema_cross": ("fast", "slow"), "vol_trend": ("fast", "slow"), "tri_ma": ("fast", "mid", "slow"), "tri_ma_vol": ("fast", "mid", "slow"), "rsi_reversion": ("low", "high"),
    "adaptive_rsi": ("q_low", "q_high"), "range_fade": ("low", "high"),
}

#: A parameter: a number (whole or not) or a text.
PARAMS = "array<struct<name:string,number:double,whole:boolean,text:string>>"
POPULATION = f"config string, family string, params {PARAMS}"
FOUND = "horizon int, fitness_pp double, oos_accuracy double, oos_cond_edge_pp double, is_cond_edge_pp double, oos_signals long, suspect boolean"
TABLE = f"{POPULATION}, {FOUND}, generation int"
COLUMNS = ["config", "family", "params", "horizon", "fitness_pp", "oos_accuracy", "oos_cond_edge_pp", "is_cond_edge_pp", "oos_signals", "suspect", "generation"]


# ---------------------------------------------------------------- populations


def label_of(family: Column, params: Column) -> Column:
    """The configuration's name, as ``stances.label`` writes it."""
    shown = lambda p: F.coalesce(p["text"], F.when(p["whole"], p["number"].cast("long").cast("string")).otherwise(p["number"].cast("string")))
    return F.concat(family, F.lit("["), F.array_join(F.transform(params, lambda p: F.concat(p["name"], F.lit("="), shown(p))), ","), F.lit("]"))


def seeds(spark: SparkSession, grid: dict) -> DataFrame:
    """The configurations of a grid as a population."""
    pack = lambda k, v: (k, None, None, v) if isinstance(v, str) else (k, float(v), isinstance(v, int), None)
    rows = [(family, [pack(k, v) for k, v in p.items()]) for family, (_, every) in grid.items() for p in every]
    return spark.createDataFrame(rows, f"family string, params {PARAMS}").select(label_of(F.col("family"), F.col("params")).alias("config"), "family", "params")


def draw(*keys) -> Column:
    """A number from 0 to 1 that hangs on the keys alone."""
    return F.pmod(F.xxhash64(*(k if isinstance(k, Column) else F.lit(k) for k in keys)), F.lit(1 << 30)) / float(1 << 30)


def _limits(family: Column, p: Column) -> tuple[Column, Column]:
    """Between what a parameter may lie, looked up in the fixed values."""
    known = F.create_map(*(x for f, names in BOUNDS.items() for n, (a, b) in names.items() for x in (F.lit(f"{f}.{n}"), F.array(F.lit(float(a)), F.lit(float(b))))))
    own = F.try_element_at(known, F.concat(family, F.lit("."), p["name"]))
    return F.coalesce(own[0], F.when(p["whole"], 2.0).otherwise(0.01)), F.coalesce(own[1], F.lit(500.0))


def _in_order(family: Column, params: Column) -> Column:
    """Parameters that must rise, dealt out by size; one that isn't above the one before it moves up by 1, or 0.05."""
    rising = F.try_element_at(F.create_map(*(x for f, names in RISING.items() for x in (F.lit(f), F.array(*map(F.lit, names))))), family)
    sizes = F.array_sort(F.transform(F.filter(params, lambda p: F.array_contains(rising, p["name"])), lambda p: p["number"]))
    gap = F.when(F.exists(params, lambda p: F.array_contains(rising, p["name"]) & ~p["whole"]), 0.05).otherwise(1.0)
    raised = F.aggregate(sizes, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.greatest(x, F.coalesce(F.try_element_at(acc, F.lit(-1)) + gap, x)))))
    dealt = F.transform(params, lambda p: F.when(F.array_contains(rising, p["name"]), p.withField("number", F.try_element_at(raised, F.array_position(rising, p["name"]).cast("int")))).otherwise(p))
    return F.when(rising.isNull(), params).otherwise(dealt)


def changed(parents: DataFrame, seed: int, generation: int, children: int = CHILDREN) -> DataFrame:
    """Children of each parent: every number is multiplied by a factor of ``SPREAD`` (a whole one moves by 1 at least), and stays within
    its limits and its order."""
    low, high = SPREAD
    rows = parents.select("config", "family", "params", F.explode(F.sequence(F.lit(1), F.lit(children))).alias("child"))

    def moved(p):
        r = draw(seed, generation, F.col("config"), F.col("child"), p["name"])
        x = p["number"] * (low + (high - low) * r)
        whole = F.when(F.bround(x) != p["number"], F.bround(x)).otherwise(p["number"] + F.when(r < 0.5, -1.0).otherwise(1.0))
        least, most = _limits(F.col("family"), p)
        return p.withField("number", F.least(F.greatest(F.when(p["whole"], whole).otherwise(F.round(x, 4)), least), most))

    rows = rows.withColumn("params", F.transform("params", lambda p: F.when(p["text"].isNotNull(), p).otherwise(moved(p))))
    rows = rows.withColumn("params", _in_order(F.col("family"), F.col("params")))
    return rows.select(label_of(F.col("family"), F.col("params")).alias("config"), "family", "params")


def elites(rows: DataFrame, n: int = ELITE) -> DataFrame:
    """Each configuration at its fittest horizon, the fittest first; suspects are left out."""
    found = [c for c in ("family", "params") if c in rows.columns] + ["horizon", "fitness_pp", "oos_accuracy", "oos_cond_edge_pp", "is_cond_edge_pp", "oos_signals"]
    best = F.max_by(F.struct(*found), F.struct("fitness_pp", -F.col("horizon")))
    return rows.where("not suspect").groupBy("config").agg(best.alias("b")).select("config", "b.*").orderBy(F.desc("fitness_pp"), "config").limit(n)


def bred(last: DataFrame, every: DataFrame, seed: int, generation: int, population: int) -> DataFrame:
    """The population after ``last`` (the rows of a generation): its elites, their children and some of ``every`` seed, each once; of more
    than ``population``, elites go first."""
    parents = elites(last).select("config", "family", "params")
    fresh = every.orderBy(draw(seed, generation, F.col("config"))).limit(IMMIGRANTS)
    ranks = (parents, changed(parents, seed, generation), fresh)
    pool = [rows.withColumn("rank", F.lit(i)) for i, rows in enumerate(ranks)]
    pool = pool[0].unionByName(pool[1]).unionByName(pool[2])
    once = pool.groupBy("config").agg(F.min("rank").alias("rank"), F.min_by(F.struct("family", "params"), "rank").alias("x"))
    return once.orderBy("rank", "config").limit(population).select("config", "x.*")


# ---------------------------------------------------------------- sweeps


def scored(bars: DataFrame, configs: list[tuple[str, str, dict]], horizons=HORIZONS, min_is: int = 200, min_oos: int = 100, grid: dict | None = None) -> DataFrame:
    """One sweep: config, horizon, fitness_pp (the lesser of its edges in and out of sample), the edges, oos_accuracy, oos_signals, and
    suspect: right so often out of sample that it must look ahead."""
    emas = sorted({*EMAS, *(p[k] for _, f, p in configs if f in ("ema_cross", "vol_trend") for k in ("fast", "slow"))})
    frame = stances.stances(with_folds(bars, tuple(emas), want=stances.reads({f for _, f, _ in configs})), configs, grid)
    rows = evaluate.sweep(frame, [n for n, _, _ in configs], horizons, min_is, min_oos)
    return rows.select("config", "horizon", F.least("is_cond_edge_pp", "oos_cond_edge_pp").alias("fitness_pp"), "oos_accuracy", "oos_cond_edge_pp", "is_cond_edge_pp", "oos_signals", (F.col("oos_accuracy") >= SUSPECT).alias("suspect"))


def _rules(population: list) -> list[tuple[str, str, dict]]:
    """Configurations as ``stances.stances`` has them."""
    value = lambda p: p["text"] if p["text"] is not None else int(p["number"]) if p["whole"] else p["number"]
    return [(r["config"], r["family"], {p["name"]: value(p) for p in r["params"]}) for r in population]


# ---------------------------------------------------------------- the table


def table(spark: SparkSession, folder: str) -> DataFrame:
    """All generations; a configuration without enough signals has one row without a horizon."""
    n = _done(spark, folder)
    return spark.read.schema(TABLE).parquet(*(f"{folder}/generation={g}" for g in range(n))) if n else spark.createDataFrame([], TABLE)


def _done(spark: SparkSession, folder: str) -> int:
    """How many generations are whole."""
    jvm, n = spark.sparkContext._jvm, 0
    store = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    while store.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/generation={n}/_SUCCESS")):
        n += 1
    return n


def progress(rows: DataFrame) -> list[float | None]:
    """The best fitness of each generation."""
    best = rows.groupBy("generation").agg(F.max(F.when(~F.col("suspect"), F.col("fitness_pp"))).alias("best")).orderBy("generation")
    return [r["best"] for r in best.collect()]


def stalled(history: list[float | None]) -> int:
    """Generations since the mark last moved. The mark moves only to a gain of more than ``BETTER``, so slow progress adds up."""
    mark, since = -math.inf, 0
    for best in history:
        gain = best is not None and best > mark + BETTER
        mark, since = (best, 0) if gain else (mark, since + 1)
    return since


def evolve(bars: DataFrame, folder: str, generations: int = 4, population: int = 24, seed: int = 1, horizons=HORIZONS, min_is: int = 200, min_oos: int = 100, grid: dict | None = None) -> DataFrame:
    """Goes on with the search in ``folder`` until it has ``generations``, or until ``PATIENCE`` of them brought nothing better, and returns
    its table. The first population is the whole grid."""
    spark, grid = bars.sparkSession, grid or stances.GRID
    every = seeds(spark, grid)
    for g in range(_done(spark, folder), generations):
        if stalled(progress(table(spark, folder))) >= PATIENCE:
            break
        own = every if g == 0 else bred(table(spark, folder).where(F.col("generation") == g - 1), every, seed, g, population)
        members = own.collect()
        found = scored(bars, _rules(members), horizons, min_is, min_oos, grid)
        whole = spark.createDataFrame(members, POPULATION).join(found, "config", "left")
        whole.withColumn("generation", F.lit(g)).select(COLUMNS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/generation={g}")
    return table(spark, folder)


def hall_of_fame(rows: DataFrame, n: int = HALL) -> DataFrame:
    """The best rows of the whole search, each configuration once."""
    return elites(rows.where("horizon is not null"), n)


def report(rows: DataFrame, generations: int, top: int = 10) -> DataFrame:
    """One row of the whole search: generations, configs_tried, suspects, last_stop, hall_of_fame (the first names, joined), champion and
    meaningful: whether it beats the luckiest of all that were tried by one standard error more. Without a champion that is false."""
    since = stalled(progress(rows))
    stop = f"no improvement for {since} generations" if since >= PATIENCE else f"budget of {generations} generations"
    place = F.row_number().over(Window.orderBy(F.desc("fitness_pp"), "config"))  # HALL rows
    hall = hall_of_fame(rows).withColumn("place", place).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= top, F.struct("place", "config")))), lambda x: x["config"]), "; ").alias("hall_of_fame"),
        F.min_by(F.struct("config", "oos_cond_edge_pp", "oos_signals"), "place").alias("b"),
    )
    figures = rows.agg(F.count_distinct("generation").alias("generations"), F.count_distinct("generation", "config").alias("configs_tried"), F.count_if(F.col("suspect")).alias("suspects"))
    luck = audit.search_verdict(F.col("b.oos_cond_edge_pp"), F.col("b.oos_signals"), F.col("configs_tried"))
    return figures.join(F.broadcast(hall)).select("generations", "configs_tried", "suspects", F.lit(stop).alias("last_stop"), "hall_of_fame", F.col("b.config").alias("champion"), F.coalesce(luck, F.lit(False)).alias("meaningful"))
