"""Claims about trading rules, from their text to a verdict: rules, configurations, one sweep, family-wise error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.operators import audit, evaluate, news, stances
from barweave.operators.folds import EMAS, with_folds
from barweave.sources.tables import shared_folder

#: Signals that a claim's rule must have in and out of sample to be tested.
MIN_IS, MIN_OOS = 150, 75
#: Families of rules in text under the names of the grid.
KNOWN = ("rsi_ma_vol", "rsi_pro_trend", "rsi_reversion", "tri_ma", "ema_cross", "boll_reversion", "donchian", "momentum", "ensemble")


def rules_of(spark: SparkSession, text: str | None) -> list[tuple[str, dict]]:
    """(family, parameters) of the rules that one text speaks of, six at most."""
    row = spark.createDataFrame([(text,)], "text string").select(news.rules_in(F.col("text")).alias("rules")).first()
    return [(r["family"], {k: _value(v) for k, v in (p.split("=") for p in r["params"].split(","))}) for r in row["rules"]]


def _value(x: str):
    return int(x) if x.isdigit() else float(x) if x.replace(".", "", 1).isdigit() else x


def configs_of(rules: list[tuple[str, dict]]) -> list[tuple[str, str, dict]]:
    """Configurations as ``stances.configs`` has them."""
    return [(stances.label(family, params), family, params) for family, params in rules if family in KNOWN]


def tested(bars: DataFrame, configs: list[tuple[str, str, dict]], min_is: int = MIN_IS, min_oos: int = MIN_OOS) -> DataFrame:
    """The sweep of a claim's configurations over all horizons."""
    emas = sorted({*EMAS, *(p[k] for _, f, p in configs if f == "ema_cross" for k in ("fast", "slow"))})
    frame = stances.stances(with_folds(bars, tuple(emas), want=stances.reads({f for _, f, _ in configs})), configs)
    return evaluate.sweep(frame, [n for n, _, _ in configs], min_is=min_is, min_oos=min_oos)


def best_of_each(sweep: DataFrame) -> DataFrame:
    """Each configuration at its best horizon out of sample."""
    best = F.max_by(F.struct("horizon", "oos_accuracy", "oos_cond_edge_pp", "oos_signals"), F.struct("oos_cond_edge_pp", -F.col("horizon")))
    return sweep.groupBy("config").agg(best.alias("b")).select("config", "b.*")


def analyse(bars: DataFrame, text: str | None, min_is: int = MIN_IS, min_oos: int = MIN_OOS) -> DataFrame:
    """One row: edge (whether the best rule survives its trials) and a note; a text without rules, and rules with too few signals, have
    no edge."""
    spark = bars.sparkSession
    configs = configs_of(rules_of(spark, text))
    if not configs:
        return spark.range(1).select(F.lit(False).alias("edge"), F.lit("no rule found").alias("note"))
    found = audit.family_wise(tested(bars, configs, min_is, min_oos)).agg(F.first("survives").alias("survives"))
    note = F.when(F.col("survives").isNull(), "too few signals").when(F.col("survives"), "survives").otherwise("does not survive")
    return found.select(F.coalesce("survives", F.lit(False)).alias("edge"), note.alias("note"))


def mentioned(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, config, family, params): the configurations that each text speaks of, each once, from all texts at once."""
    rules = texts.select(*keys, F.explode(news.rules_in(F.col("text"))).alias("r")).select(*keys, "r.family", "r.params").where(F.col("family").isin(*KNOWN))
    return rules.select(*keys, F.concat("family", F.lit("["), "params", F.lit("]")).alias("config"), "family", "params").distinct()


def sweep_of(bars: DataFrame, wanted: DataFrame, folder: str, batch: int = 64, min_is: int = MIN_IS, min_oos: int = MIN_OOS) -> DataFrame:
    """The sweep of all configurations of ``wanted`` (config, family, params), however many texts speak of each: (config, horizon, figures).
    The distinct ones come to the driver ``batch`` at a time, as the names its rules are built of, and each batch is a table of its own."""
    spark, paths = bars.sparkSession, []
    rows, part = wanted.select("config", "family", "params").distinct().orderBy("config").toLocalIterator(), []

    def run() -> None:
        configs = [(r["config"], r["family"], {k: _value(v) for k, v in (p.split("=") for p in r["params"].split(","))}) for r in part]
        path = f"{folder}/batch={len(paths)}"
        tested(bars, configs, min_is, min_oos).write.mode("overwrite").parquet(path)
        paths.append(path)
        part.clear()

    for row in rows:
        part.append(row)
        if len(part) == batch:
            run()
    if part:
        run()
    figures = "config string, horizon int, oos_signals long, oos_cond_edge_pp double"
    return spark.read.parquet(*paths).select("config", "horizon", "oos_signals", "oos_cond_edge_pp") if paths else spark.createDataFrame([], figures)


def verdicts(bars: DataFrame, texts: DataFrame, keys: list[str], min_is: int = MIN_IS, min_oos: int = MIN_OOS, batch: int = 64) -> DataFrame:
    """One row a text: keys, best (its best configuration out of sample), horizon, oos_cond_edge_pp, trials (configurations and horizons
    that were scored), edge (whether the best survives so many trials) and note.

    Keys are unique and not null. A null or empty text has no rule; a rule with too few signals is no trial. Ties go to the shorter
    horizon, then to the name that sorts last.
    """
    spark = bars.sparkSession
    folder = shared_folder(spark, "claims")
    mentioned(texts, keys).write.parquet(f"{folder}/mentioned")
    said = spark.read.parquet(f"{folder}/mentioned")
    sweep = sweep_of(bars, said, f"{folder}/sweep", batch, min_is, min_oos)
    scored = said.join(sweep, "config").where("oos_signals > 0").groupBy(*keys).agg(
        F.max_by(F.struct("config", "horizon", "oos_signals", "oos_cond_edge_pp"), F.struct("oos_cond_edge_pp", -F.col("horizon"), "config")).alias("b"), F.count("*").alias("trials")
    )
    scored = scored.select(*keys, F.col("b.config").alias("best"), "b.horizon", "b.oos_cond_edge_pp", "trials", audit.edge_error(F.col("b.oos_cond_edge_pp"), F.col("b.oos_signals"), F.col("trials"))["survives"].alias("survives"))
    any_rule = said.select(*keys).distinct().withColumn("has_rule", F.lit(True))
    rows = texts.select(*keys).join(any_rule, keys, "left").join(scored, keys, "left")
    note = F.when(F.col("has_rule").isNull(), "no rule found").when(F.col("trials").isNull(), "too few signals").when(F.col("survives"), "survives").otherwise("does not survive")
    return rows.select(*keys, "best", "horizon", "oos_cond_edge_pp", F.coalesce("trials", F.lit(0)).alias("trials"), F.coalesce("survives", F.lit(False)).alias("edge"), note.alias("note"))
