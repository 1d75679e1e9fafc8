"""The driver's tables in the roles of an event log, a sensor log and forecasts.

Each role is one SQL expression that Spark and DuckDB read alike, so queries and their SQL start from the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LOG = {
    "k1": "l_orderkey", "k2": "l_partkey", "k3": "l_linenumber", "entity": "l_suppkey", "other": "o_custkey",
    "period": "CAST(year(o_orderdate) AS INT)", "y": "CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END", "state": "NULLIF(o_orderstatus, 'P')",
    "pitcher_hand": "l_linestatus", "batter_hand": "NULLIF(o_orderstatus, 'P')",
    "balls": "CASE WHEN l_quantity = 50 THEN NULL ELSE l_linenumber % 4 END", "strikes": "CAST(l_quantity AS INT) % 3",
    "outs": "CASE WHEN l_quantity = 49 THEN NULL ELSE CAST(o_custkey % 3 AS INT) END", "inning": "CASE WHEN l_quantity = 48 THEN NULL ELSE l_linenumber + 4 END",
    "runners": "CAST(l_partkey % 4 AS INT)", "on_2b": "CAST(l_partkey % 2 AS INT)", "on_3b": "CAST(l_suppkey % 2 AS INT)",
    "score_diff": "CASE WHEN l_quantity = 47 THEN NULL ELSE CAST(l_partkey % 9 AS INT) - 4 END", "li": "CASE WHEN l_quantity = 46 THEN NULL ELSE l_extendedprice / 20000.0 END",
    "base_state": "CASE WHEN l_quantity = 45 THEN '__MISSING__' ELSE l_returnflag END",
    "pitcher_n": "CASE WHEN l_quantity < 3 THEN NULL ELSE CAST(l_quantity AS INT) END", "batter_n": "CAST(l_quantity AS INT) - 1", "mix_n": "CASE WHEN l_quantity > 40 THEN NULL ELSE CAST(l_quantity AS INT) END",
    "career_n": "CAST(l_partkey % 200 AS INT)", "history_missing": "CASE WHEN l_partkey % 200 = 0 THEN 1 ELSE 0 END", "sensor_n": "CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 50 AS INT) END",
    "pitcher_success": "NULLIF(l_discount, 0) * 10", "pitcher_middle": "NULLIF(l_tax, 0) * 12.5", "pitcher_reverse": "l_discount * 12", "pitcher_strike": "l_discount * 7", "pitcher_ball": "l_tax * 9",
    "batter_success": "NULLIF(l_tax, 0) * 10", "batter_middle": "NULLIF(l_discount, 0) * 6",
    "prev1_success": "NULLIF(l_discount, 0.02) * 8", "prev3_success": "NULLIF(l_discount, 0.03) * 7", "prev5_success": "NULLIF(l_discount, 0.04) * 6",
    "prev1_middle": "NULLIF(l_tax, 0.02) * 8", "prev3_middle": "NULLIF(l_tax, 0.03) * 7", "prev5_middle": "NULLIF(l_tax, 0.04) * 6",
    "fastball": "NULLIF(l_discount, 0.01) * 11", "breaking": "NULLIF(l_tax, 0.01) * 10", "offspeed": "NULLIF(l_discount, 0.05) * 5",
    "p": "l_discount * 5 + 0.25",
}
EVENTS = {
    "entity": "user_id", "event_id": "event_id", "day": "CAST(day(ts) AS INT)", "period": "CAST(floor((day(ts) - 1) / 6.0) AS INT)", "kind": "event_type", "value": "value",
    "reading": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END", "y": "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END",
}


#: The raw columns of a log, those that have NULLs with NULLs.
RAW = {
    "season": "CAST(year(o_orderdate) AS INT)", "game_month": "CAST(month(o_orderdate) AS INT)", "game_dayofweek": "CAST(l_linenumber % 7 AS INT)", "inning": LOG["inning"], "balls_before": LOG["balls"],
    "strikes_before": LOG["strikes"], "outs_before": LOG["outs"], "run_top_before": "CAST(l_partkey % 5 AS INT)", "run_bot_before": "CAST(l_partkey % 6 AS INT)", "run_total_before": "CAST(l_partkey % 11 AS INT)",
    "score_diff_home": LOG["score_diff"], "score_diff_pitcher_team": LOG["score_diff"], "runner_on_1b": "CAST(l_partkey % 3 AS INT)", "runner_on_2b": LOG["on_2b"], "runner_on_3b": LOG["on_3b"],
    "num_runners_on": LOG["runners"], "home_win_expectancy": "l_discount * 50", "away_win_expectancy": "l_tax * 50", "li": LOG["li"], "asof_pitcher_n": LOG["pitcher_n"], "asof_batter_n": LOG["batter_n"],
    "asof_pitcher_pitchmix_n": LOG["mix_n"], **{f"asof_pitcher_{k}_rate": LOG[f"pitcher_{k}"] for k in ("success", "reverse", "middle", "ball", "strike")},
    **{f"asof_pitcher_prev{n}_game_{k}_rate": LOG[f"prev{n}_{k}"] for n in (1, 3, 5) for k in ("success", "middle")}, "asof_batter_success_rate": LOG["batter_success"],
    "asof_batter_middle_rate": LOG["batter_middle"], **{f"asof_pitcher_{k}_rate": LOG[k] for k in ("fastball", "breaking", "offspeed")},
    "top_bottom": "l_linestatus", "game_type": "o_orderstatus", "base_state": "NULLIF(l_returnflag, 'A')", "pitcher_id": "CAST(l_suppkey AS VARCHAR(20))", "batter_id": "CAST(o_custkey AS VARCHAR(20))",
    "pitcher_team_id": "CAST(l_suppkey % 9 AS VARCHAR(20))", "batter_team_id": "CAST(o_custkey % 9 AS VARCHAR(20))", "pitcher_hand": "l_linestatus", "batter_hand": LOG["batter_hand"],
}


def _sql(roles: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {n}" for n, e in roles.items()) + f" FROM {source}"


#: The two views as common table expressions for DuckDB.
LOG_SQL = f"log AS ({_sql(LOG, 'lineitem JOIN orders ON l_orderkey = o_orderkey')})"
EVENTS_SQL = f"ev AS ({_sql(EVENTS, 'events')})"


RAW_SQL = f"raw AS ({_sql({k: LOG[k] for k in ('k1', 'k2', 'k3', 'entity')} | RAW, 'lineitem JOIN orders ON l_orderkey = o_orderkey')})"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    roles = {k: LOG[k] for k in ("k1", "k2", "k3", "entity")} | RAW
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).selectExpr(*[f"{e} AS {n}" for n, e in roles.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).selectExpr(*[f"{e} AS {n}" for n, e in LOG.items()])


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*[f"{e} AS {n}" for n, e in EVENTS.items()])
