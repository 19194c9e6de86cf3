"""Queries of tables with upserts, of Markdown notes and of the graph page."""

from __future__ import annotations

from pyspark.sql import functions as F

from barweave.operators import graph, ledger, notes
from barweave.plans import misc_q
from barweave.plans.catalogue import query
from barweave.plans.indicators_q import DAYS
from barweave.sources import tables, upserts, vault
from barweave.sources.tables import daily_bars

PNL = "day date, mode string, realized_pnl double, trades_count long, halted boolean"
BY_MODE = "dm AS (SELECT CAST(exit_time AS DATE) AS day, mode, round(sum(pnl), 2) AS realized_pnl, count(*) AS trades_count FROM led WHERE exit_time IS NOT NULL GROUP BY ALL)"


@query("src12_daily_pnl_upserts", misc_q.L.rstrip() + ",\n" + BY_MODE + """ SELECT day, mode, round(CASE WHEN mode = 'paper' AND day >= DATE '1995-01-01' THEN realized_pnl - trades_count ELSE realized_pnl END, 1) AS realized_pnl, trades_count,
  mode = 'paper' AND day >= DATE '1995-01-01' AND realized_pnl < 0 AS halted FROM dm
UNION ALL SELECT DATE '2030-01-01', 'paper', 0.0, 0, false""")
def daily_pnl_upserts(spark, d):
    """Days of both modes in a table; then the paper days since 1995 are written anew, with costs and halts, and a day is added. Only the
    partition of the paper mode is touched."""
    table = upserts.UpsertTable(spark, tables.shared_folder(spark, "pnl"), PNL, ["day", "mode"], "mode")
    trades = misc_q.trades(spark, d)
    table.upsert(ledger.daily_rollup(trades, "paper").unionByName(ledger.daily_rollup(trades, "backtest")))
    late = table.read().where("mode = 'paper' and day >= date '1995-01-01'")
    late = late.withColumns({"halted": F.col("realized_pnl") < 0, "realized_pnl": F.col("realized_pnl") - F.col("trades_count")})
    table.upsert(late.unionByName(spark.sql("select date '2030-01-01' as day, 'paper' as mode, 0.0d as realized_pnl, 0L as trades_count, false as halted")))
    return table.read().withColumn("realized_pnl", F.round("realized_pnl", 1))


@query("src15_markdown_vault", DAYS + """, s AS (SELECT symbol, count(*) AS n, min(ts) AS a, max(ts) AS b FROM bars GROUP BY symbol)
SELECT 'symbols' AS folder, symbol AS slug, CASE WHEN symbol = 'LARGE' THEN 0 ELSE 1 END AS batch, 'symbol' AS type, strftime(b, '%Y-%m-%d') AS data_through, 'Daily bars: ' || n || ', from ' || strftime(a, '%Y-%m-%d') || ' to ' || strftime(b, '%Y-%m-%d') || '. Part of [[Universe]].' AS body FROM s""")
def markdown_vault(spark, d):
    """Notes of symbols as Markdown with front matter, written twice; one of them is still fresh the second time. Read back from the
    newest files."""
    rows, path = notes.symbol_notes(daily_bars(spark, d)), tables.shared_folder(spark, "vault")
    day = lambda x: F.to_date(F.lit(x))
    nothing = rows.where("false").select("slug", day("2024-01-01").alias("updated"), "data_through", F.lit(False).alias("pinned"))
    vault.write_decided(rows, graph.decide(rows, nothing, day("2024-01-20")), path, day("2024-01-20"))
    old = rows.select("slug", F.when(F.col("slug") == "LARGE", day("2024-01-31")).otherwise(day("2024-01-20")).alias("updated"), "data_through", F.lit(False).alias("pinned"))
    vault.write_decided(rows, graph.decide(rows, old, day("2024-02-01")), path, day("2024-02-01"))
    found = vault.current(vault.read(spark, path)).withColumn("head", graph.parse_front_matter(F.col("text")))
    body = F.regexp_extract("text", r"(?s)\n---\n\n# [^\n]*\n\n(.*?)\n(?:\n## Links|$)", 1)
    return found.select("folder", "slug", "batch", F.col("head")["type"].alias("type"), F.col("head")["data_through"].alias("data_through"), body.alias("body"))


@query("src16_graph_page", misc_q.G + "SELECT 'node' AS kind, id, grp AS other, value FROM nd UNION ALL SELECT 'edge', src, dst, NULL FROM ed")
def graph_page(spark, d):
    """The graph page of the notes, and the nodes and edges that are read out of it again."""
    path = tables.shared_folder(spark, "page")
    vault.write_page(misc_q.nodes(spark, d), graph.links_of(misc_q.notes(spark, d)), path)
    lines = spark.read.text(f"{path}/page").where("value like '{%}_'")
    found = lines.select(F.from_json(F.expr("rtrim(',', value)"), "id string, grp string, value long, src string, dst string").alias("x")).select("x.*")
    return found.select(F.when(F.col("src").isNull(), "node").otherwise("edge").alias("kind"), F.coalesce("id", "src").alias("id"), F.coalesce("grp", "dst").alias("other"), "value")
