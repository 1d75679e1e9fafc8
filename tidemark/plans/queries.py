"""One query per operator over the driver's tables, each with the SQL that it must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import blocks, coldstart, evaluate, export, history, lab, models, report, resolve, stability, tables, validate
from ..operators.quantiles import quantiles
from ..sources.files import append_history, first_rows, read_csv, read_history, read_mapping, with_row_order, work_folder, write_csv, write_features
from ..sources.views import EVENTS_SQL, LOG_SQL, RAW_SQL, events, log, raw, table
from .catalog import query

C = F.col
KEYS = "k1, k2, k3, entity"
KEY_COLUMNS = ["k1", "k2", "k3", "entity"]
W = f"WITH {LOG_SQL}"
E = f"WITH {EVENTS_SQL}"
PAST = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(C(c), digits).alias(c) if t == "double" else C(c) for c, t in df.dtypes])


def flag_sql(condition: str, name: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END AS {name}"


def projected(spark, d, columns: dict) -> DataFrame:
    return rounded(log(spark, d).select(*KEY_COLUMNS, *[c.alias(n) for n, c in columns.items()]))


# --- the flagship first ---------------------------------------------------------------------------------------------------------


@query(f"""{W}, s AS (SELECT DISTINCT period FROM log), g AS (SELECT s.period, avg(y) AS g FROM s JOIN log ON log.period < s.period GROUP BY 1),
    h AS (SELECT s.period, entity, sum(y) AS t, count(*) AS n FROM s JOIN log ON log.period < s.period GROUP BY 1, 2)
    SELECT entity, period, round((t + 50 * g) / (n + 50), 6) AS rate, CAST(n AS BIGINT) AS n FROM h JOIN g USING (period)""")
def W01_strict_prior(spark, d):
    return rounded(history.smoothed_rates(log(spark, d), ["entity"], "period", "y"))


# --- sources and sinks ------------------------------------------------------------------------------------------------------------


CSV = "entity long, event_id long, kind string, value double"


def _csv(spark, d) -> str:
    path = work_folder(spark)
    write_csv(events(spark, d).select("entity", "event_id", F.when(C("kind") != "error", C("kind")).alias("kind"), "value"), path)
    return path


@query(f"{E} SELECT entity, event_id, NULLIF(kind, 'error') AS kind, value FROM ev")
def S01_csv_scan(spark, d):
    return read_csv(spark, _csv(spark, d), CSV)


@query(f"{E} SELECT event_id, value FROM ev")
def S02_pruned_csv(spark, d):
    return read_csv(spark, _csv(spark, d), CSV, ["event_id", "value"])


@query(f"{E} SELECT event_id, kind FROM ev ORDER BY event_id LIMIT 300")
def S04_first_rows(spark, d):
    return first_rows(events(spark, d).select("event_id", "kind"), "event_id", 300)


@query(f"{E} SELECT event_id, NULLIF(kind, 'error') AS kind, coalesce(kind IN ('click', 'view') AND value IS NOT NULL, FALSE) AS accepted FROM ev")
def S06_mapping(spark, d):
    return read_mapping(spark, _csv(spark, d), CSV, "value", "kind", ["click", "view"]).select("event_id", "kind", "accepted")


@query(f"{E} SELECT event_id, reading FROM ev")
def S07_parquet_sink(spark, d):
    path = work_folder(spark)
    write_features(events(spark, d).select("event_id", "reading"), path)
    return spark.read.parquet(path)


@query(f"{E} SELECT event_id, kind, NULL::DOUBLE AS value FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL, value FROM ev WHERE event_id % 2 = 1")
def S12_history(spark, d):
    path, rows = work_folder(spark), events(spark, d)
    append_history(rows.filter("event_id % 2 = 0").select("event_id", "kind"), path)
    append_history(rows.filter("event_id % 2 = 1").select("event_id", "value"), path)
    return read_history(spark, path).select("event_id", "kind", "value")


# --- projections ----------------------------------------------------------------------------------------------------------------


@query(f"""{W} SELECT {KEYS}, CAST(try_cast(CASE WHEN k1 % 3 = 0 THEN 'x' WHEN k1 % 5 = 0 THEN 'NaN' ELSE CAST(k2 AS VARCHAR) END AS DOUBLE) AS DOUBLE) AS v, CAST(entity AS VARCHAR) AS id FROM log
    WHERE k1 % 5 <> 0 OR k1 % 3 = 0 UNION ALL SELECT {KEYS}, NULL, CAST(entity AS VARCHAR) FROM log WHERE k1 % 5 = 0 AND k1 % 3 <> 0""")
def P02_safe_numbers(spark, d):
    text = F.when(C("k1") % 3 == 0, "x").when(C("k1") % 5 == 0, "NaN").otherwise(C("k2").cast("string"))
    return projected(spark, d, {"v": scalars.number(text), "id": scalars.identifier(C("entity").cast("double").cast("string"))}).withColumn("id", scalars.identifier(C("entity")))


@query(f"{W} SELECT {KEYS}, CAST(balls AS VARCHAR) || '-' || CAST(strikes AS VARCHAR) AS count_state FROM log")
def P04_count_state(spark, d):
    return projected(spark, d, {"count_state": blocks.count_state()})


@query(f"""{W} SELECT {KEYS}, {flag_sql('strikes > balls', 'pitcher_ahead')}, {flag_sql('balls > strikes', 'batter_ahead')}, {flag_sql('strikes = 2', 'two_strike')},
    {flag_sql('balls = 3', 'three_ball')}, {flag_sql('balls = 3 AND strikes = 2', 'full_count')} FROM log""")
def P05_count_flags(spark, d):
    return projected(spark, d, blocks.count_flags())


@query(f"{W} SELECT {KEYS}, {flag_sql('runners > 0', 'has_runner')}, {flag_sql('on_2b = 1 OR on_3b = 1', 'risp')}, {flag_sql('runners = 3', 'bases_loaded')} FROM log")
def P06_runner_flags(spark, d):
    return projected(spark, d, blocks.runner_flags())


@query(f"{W} SELECT {KEYS}, {flag_sql('score_diff = 0', 'is_tie')}, abs(score_diff) AS score_diff_abs, {flag_sql('abs(score_diff) <= 2', 'close_game')} FROM log")
def P07_score_flags(spark, d):
    return projected(spark, d, blocks.score_flags())


@query(f"{W} SELECT {KEYS}, {flag_sql('inning >= 7', 'late_inning')}, {flag_sql('inning >= 10', 'extra_inning')}, {flag_sql('period >= 1999', 'rule_era')} FROM log")
def P08_stage_flags(spark, d):
    return projected(spark, d, blocks.stage_flags(1999))


@query(f"{W} SELECT {KEYS}, CASE WHEN inning <= 3 THEN 'early' WHEN inning <= 6 THEN 'middle' WHEN inning <= 9 THEN 'late' ELSE 'extra' END AS phase FROM log")
def P09_phase_case(spark, d):
    return projected(spark, d, {"phase": blocks.stage_phase()})


@query(f"{W} SELECT {KEYS}, CASE WHEN pitcher_hand IS NULL OR batter_hand IS NULL THEN 'missing' WHEN pitcher_hand = batter_hand THEN 'same' ELSE 'opposite' END AS matchup FROM log")
def P10_matchup(spark, d):
    return projected(spark, d, {"matchup": blocks.matchup()})


@query(f"""{W} SELECT {KEYS}, {", ".join(f"CASE WHEN {n} IS NOT NULL THEN round(ln(1 + greatest({n}, 0)), 6) END AS {n}_log1p, {flag_sql(f'{n} IS NULL', f'{n}_missing')}" for n in ("pitcher_n", "batter_n", "mix_n"))} FROM log""")
def P11_log_counters(spark, d):
    return projected(spark, d, blocks.counters())


def _trend_sql() -> str:
    out = [f"round(prev{a}_{k} - prev{b}_{k}, 6) AS {k}_trend_{a}v{b}" for k in ("success", "middle") for a, b in ((1, 3), (1, 5), (3, 5))]
    out += [f"round(prev1_{k} - pitcher_{k}, 6) AS {k}_prev1_gap, round(pitcher_{k} - batter_{k}, 6) AS {k}_batter_gap" for k in ("success", "middle")]
    out += [" + ".join(f"CASE WHEN prev{n}_{k} IS NULL THEN 0 ELSE 1 END" for n in (1, 3, 5)) + f" AS {k}_trend_sources" for k in ("success", "middle")]
    return ", ".join([*out, "round(pitcher_strike - pitcher_ball, 6) + 0.0 AS strike_ball_gap"])


@query(f"{W} SELECT {KEYS}, {_trend_sql()} FROM log")
def P12_trends(spark, d):
    return projected(spark, d, blocks.trends())


@query(f"""{W}, b AS (SELECT *, {flag_sql('inning >= 7', 'late')}, {flag_sql('abs(score_diff) <= 2', 'close')}, {flag_sql('on_2b = 1 OR on_3b = 1', 'risp')}, {flag_sql('runners = 3', 'loaded')},
    {flag_sql('balls = 3 AND strikes = 2', 'full_')}, CASE WHEN li IS NOT NULL THEN ln(1 + greatest(li, 0)) END AS ll, CAST(balls AS VARCHAR) || '-' || CAST(strikes AS VARCHAR) AS cs FROM log)
    SELECT {KEYS}, round(ll, 6) AS li_log1p, {flag_sql('li >= 2', 'high_leverage')}, late * close AS close_late, {flag_sql('late = 1 AND close = 1 AND li >= 2', 'late_close_high_li')},
    round(ll * (1 + late) * (1 + close), 6) AS pressure_score, {flag_sql('risp = 1 AND outs = 2', 'risp_two_out')}, {flag_sql('loaded = 1 AND outs < 2', 'bases_loaded_less_two_out')},
    round(CASE WHEN outs IS NOT NULL THEN runners * greatest(3.0 - outs, 0) / 3.0 END, 6) AS runner_out_pressure, round(full_ * ll, 6) AS count_pressure,
    coalesce(base_state || '|o' || CAST(outs AS VARCHAR), '__MISSING__') AS base_out_state, coalesce(cs || '|' || base_state || '|o' || CAST(outs AS VARCHAR), '__MISSING__') AS count_base_out_state FROM b""")
def P13_situation(spark, d):
    base = log(spark, d).withColumns(blocks.count_flags() | blocks.runner_flags() | blocks.score_flags() | blocks.stage_flags() | {"count_state": blocks.count_state()})
    added, _, _ = blocks.apply_feature_set(base, ["situation"])
    return rounded(added.select(*KEY_COLUMNS, *blocks.situation()))


@query(f"""{W}, r AS (SELECT *, CASE WHEN fastball IS NOT NULL THEN least(greatest(fastball, 0), 1) END AS f, CASE WHEN breaking IS NOT NULL THEN least(greatest(breaking, 0), 1) END AS b,
    CASE WHEN offspeed IS NOT NULL THEN least(greatest(offspeed, 0), 1) END AS o FROM log),
    t AS (SELECT *, CASE WHEN f IS NULL AND b IS NULL AND o IS NULL THEN NULL ELSE coalesce(f, 0) + coalesce(b, 0) + coalesce(o, 0) END AS s FROM r)
    SELECT {KEYS}, CASE WHEN s > 0 THEN round(-({" + ".join(f"coalesce({x} / s * ln(greatest({x} / s, 1e-8)), 0)" for x in "fbo")}), 6) + 0.0 END AS mix_entropy, round(greatest(f, b, o), 6) AS mix_dominant, round(least(f, b, o), 6) AS mix_balance,
    round(f - b, 6) AS mix_fastball_breaking, round(f - o, 6) AS mix_fastball_offspeed, round(b - o, 6) AS mix_breaking_offspeed, round(s, 6) AS mix_sum, {flag_sql('mix_n > 0', 'mix_available')} FROM t""")
def P14_pitchmix(spark, d):
    return projected(spark, d, blocks.mix())


@query(f"""{W}, r AS (SELECT *, {", ".join(f"CASE WHEN {n} IS NOT NULL THEN greatest({n}, 0) / (greatest({n}, 0) + {k}.0) END AS {a}" for n, k, a in (("pitcher_n", 50, "ps"), ("batter_n", 50, "bs"), ("mix_n", 50, "ms"), ("career_n", 100, "hs"), ("sensor_n", 100, "ss")))} FROM log)
    SELECT {KEYS}, round(ps, 6) AS pitcher_share, round(bs, 6) AS batter_share, round(ms, 6) AS mix_share, round(hs, 6) AS history_share, round(ss, 6) AS sensor_share,
    round(ps * pitcher_success - bs * batter_success, 6) AS weighted_gap,
    {" + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in ("ps > 0", "bs > 0", "ms > 0", "history_missing = 0", "ss > 0"))} AS information_sources FROM r""")
def P15_reliability(spark, d):
    return projected(spark, d, blocks.reliability())


@query(f"""{W}, r AS (SELECT *, {", ".join(f"CASE WHEN {n} BETWEEN 0 AND 1 THEN {n} END AS {a}" for n, a in (("pitcher_success", "s"), ("batter_success", "o"), ("pitcher_reverse", "r"), ("pitcher_middle", "m"), ("pitcher_ball", "b")))} FROM log)
    SELECT {KEYS}, CASE WHEN pitcher_hand IS NOT NULL AND batter_hand IS NOT NULL THEN CAST(pitcher_hand = batter_hand AS DOUBLE) END AS hand_match, round(s * o, 6) AS success_interact, round(r * m, 6) AS reverse_x_middle,
    round((1 - o) * r, 6) AS threat_x_reverse, round((1 - o) * m, 6) AS threat_x_middle, round((1 - o) * b, 6) AS threat_x_ball FROM r""")
def P16_threat(spark, d):
    return projected(spark, d, blocks.threat())


@query(f"WITH {RAW_SQL} SELECT {KEYS}, {', '.join([f'CAST({c} AS FLOAT) AS {c}' for c in blocks.RAW_NUMERIC] + [f'''coalesce({c}, '__MISSING__') AS {c}''' for c in blocks.RAW_CATEGORICAL])} FROM raw")
def P21_raw_view(spark, d):
    return blocks.raw_view(raw(spark, d), KEY_COLUMNS)


@query(f"""{W}, {", ".join(["r AS (SELECT *, " + ", ".join(f"CASE WHEN {n} IS NOT NULL THEN least(greatest({n}, 0), 1) END AS {a}" for n, a in (("fastball", "f"), ("breaking", "b"), ("offspeed", "o"))) + " FROM log)"])},
    t AS (SELECT *, CASE WHEN f IS NULL AND b IS NULL AND o IS NULL THEN NULL ELSE coalesce(f, 0) + coalesce(b, 0) + coalesce(o, 0) END AS s FROM r)
    SELECT {KEYS}, round(greatest(f, b, o), 6) AS mix_dominant, round(least(f, b, o), 6) AS mix_balance, round(s, 6) AS mix_sum, {flag_sql('mix_n > 0', 'mix_available')},
    CASE WHEN pitcher_hand IS NOT NULL AND batter_hand IS NOT NULL THEN CAST(pitcher_hand = batter_hand AS DOUBLE) END AS hand_match FROM t""")
def P18_glob_drop(spark, d):
    out, _, found = blocks.apply_feature_set(log(spark, d), ["mix", "threat"], ["mix_*_*", "mix_entropy", "threat_x_*", "*_interact", "reverse_*"])
    return rounded(out.select(*KEY_COLUMNS, *[n for n in found["added"] if n not in found["dropped"]]))


@query("SELECT * FROM (VALUES ('trends', CAST(13 AS BIGINT)), ('situation', 11), ('mix', 8), ('reliability', 7), ('threat', 6)) AS t(block, n)")
def P19_catalog(spark, d):
    return blocks.feature_catalog(spark).groupBy("block").agg(F.count("*").alias("n"))


@query(f"{W} SELECT {KEYS}, coalesce(state, 'nan') || '|' || CAST(period AS VARCHAR) || '|' || coalesce(CAST(balls AS VARCHAR), 'nan') AS key FROM log")
def P23_composite_key(spark, d):
    return projected(spark, d, {"key": scalars.composite_key(C("state"), C("period"), C("balls"))})


@query(f"{W} SELECT {KEYS}, NULLIF(base_state, '__MISSING__') AS hand FROM log")
def P24_known_hand(spark, d):
    return projected(spark, d, {"hand": blocks.known_hand(C("base_state"))})


@query(f"{W} SELECT {KEYS}, CASE state WHEN 'F' THEN '1' WHEN 'O' THEN '2' END AS code FROM log")
def P22_recode(spark, d):
    return projected(spark, d, {"code": tables.recode(C("state"), {"F": "1", "O": "2"})})


@query(f"{W} SELECT {KEYS}, round(ln(least(greatest(p, 0.00001), 0.99999) / (1 - least(greatest(p, 0.00001), 0.99999))), 6) AS logit FROM log")
def P25_logit(spark, d):
    return projected(spark, d, {"logit": scalars.logit(C("p"))})


BOARD = f"{W}, board AS (SELECT entity, period, avg((p - y) * (p - y)) AS brier FROM log GROUP BY 1, 2)"
#: The board as a history of runs.
RUN = {
    "experiment": "CAST(entity % 20 AS VARCHAR(9))", "status": "CASE WHEN entity % 3 = 0 THEN 'failed' ELSE 'success' END", "data_signature": "'s' || CAST(period % 2 AS VARCHAR(9))",
    "config_hash": "'c' || CAST(entity % 4 AS VARCHAR(9))", "mode": "CASE WHEN entity % 7 = 1 THEN 'quick' ELSE 'full' END", "finished_at": "CAST(period * 100000 + entity AS VARCHAR(9))",
    "model_family": "CASE WHEN entity % 5 = 0 THEN 'other' ELSE 'boosted' END", "preprocessing_stage": "'stage' || CAST(period % 3 AS VARCHAR(9))", "elapsed_seconds": "CAST(entity % 11 AS DOUBLE)", "brier": "brier",
}
RUNS = f"{BOARD}, runs AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RUN.items())} FROM board)"
MIX = ", ".join(f"round(count(*) FILTER (kind = '{k}') / count(*)::DOUBLE, 6) AS mix_{k}" for k in ("click", "view", "purchase"))


def _board(spark, d):
    return log(spark, d).groupBy("entity", "period").agg(F.avg((C("p") - C("y")) ** 2).alias("brier"))


def _runs(spark, d):
    return _board(spark, d).selectExpr(*[f"{e} AS {n}" for n, e in RUN.items()])


# --- filters, joins, set operations -----------------------------------------------------------------------------------------------


@query(f"""{W}, p AS (SELECT 'train' AS part, * FROM log WHERE period < 2000 UNION ALL SELECT 'valid', * FROM log WHERE period = 2000 UNION ALL SELECT 'tuning_train', * FROM log WHERE period < 1999 UNION ALL SELECT 'tuning_valid', * FROM log WHERE period = 1999)
    SELECT part, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives FROM p GROUP BY 1""")
def F01_splits(spark, d):
    rows = log(spark, d).select("period", "y")
    at, before = validate.split(rows, "period", 2000, "y"), validate.split(rows, "period", 1999, "y")
    parts = {"train": at.train, "valid": at.valid, "tuning_train": before.train, "tuning_valid": before.valid}
    counts = [x.agg(F.lit(n).alias("part"), F.count("*").alias("n"), F.sum("y").cast("bigint").alias("positives")) for n, x in parts.items()]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


@query(f"{E} SELECT event_id, kind FROM ev WHERE kind IN ('click', 'view')")
def F04_members(spark, d):
    return tables.members(events(spark, d), "kind", ["click", "view"]).select("event_id", "kind")


@query(f"{RUNS}, c AS (SELECT * FROM runs WHERE status = 'success' AND data_signature = 's0' AND mode = 'full') SELECT experiment, round(brier, 6) AS brier FROM c QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY finished_at DESC) = 1")
def F08_comparable(spark, d):
    return rounded(evaluate.leaderboard(_runs(spark, d), {"data_signature": "s0", "mode": "full"}).select("experiment", "brier"))


@query(f"{RUNS}, h AS (SELECT unnest(['c0', 'c1', 'c2', 'c3', 'c9']) AS config_hash) SELECT config_hash, config_hash IN (SELECT config_hash FROM runs WHERE status = 'success' AND data_signature = 's0' AND mode = 'quick') AS done FROM h")
def F08_completed(spark, d):
    runs = _runs(spark, d)
    done = [(h, lab.already_completed(runs, "s0", h, "quick")) for h in ("c0", "c1", "c2", "c3", "c9")]
    return spark.createDataFrame(done, "config_hash string, done boolean")


@query("""WITH x AS (SELECT p_partkey AS position, p_name || '/' || CAST(p_partkey AS VARCHAR) AS name, p_size % 5 <> 0 AS enabled, p_brand AS brand, p_container AS container FROM part)
    SELECT 'Brand#11' AS preset, position AS turn, name FROM x WHERE enabled AND (brand = 'Brand#11' OR container = 'Brand#11') UNION ALL SELECT 'all', position, name FROM x WHERE enabled""")
def F09_select(spark, d):
    """Presets are a part's brand and, where the table has one, its container; the driver's tables have none, so the SQL, which names it, can't run on them."""
    parts = table(spark, d, "part")
    name = F.concat("p_name", F.lit("/"), C("p_partkey").cast("string"))
    presets = [c for c in ("p_brand", "p_container") if c in parts.columns]
    experiments = parts.select(C("p_partkey").alias("position"), name.alias("name"), (C("p_size") % 5 != 0).alias("enabled"), F.array(*presets).alias("presets"))
    return lab.selected(experiments, "Brand#11").withColumn("preset", F.lit("Brand#11")).unionByName(lab.selected(experiments, "all").withColumn("preset", F.lit("all")))


@query(f"{E}, g AS (SELECT entity, day FROM ev GROUP BY 1, 2 HAVING bool_or(kind = 'click') AND bool_or(kind = 'view')) SELECT event_id FROM ev JOIN g USING (entity, day)")
def F05_both_halves(spark, d):
    return resolve.with_both(events(spark, d), ["entity", "day"], "kind", ["click", "view"]).select("event_id")


@query(f"{E} SELECT event_id FROM ev QUALIFY count(*) OVER (PARTITION BY entity, day, kind) = 1")
def F06_unique_keys(spark, d):
    return tables.only_unique(events(spark, d), ["entity", "day", "kind"]).select("event_id")


@query(f"{W}, t AS (SELECT state, round(avg(y), 6) AS m FROM log GROUP BY 1) SELECT {KEYS}, log.state, m FROM log LEFT JOIN t ON log.state IS NOT DISTINCT FROM t.state")
def J01_nullsafe_lookup(spark, d):
    rows = log(spark, d)
    means = rounded(rows.groupBy("state").agg(F.avg("y").alias("m")))
    return history.null_safe_join(rows.select(*KEY_COLUMNS, "state"), means, ["state"])


@query("SELECT o_custkey, n, c_nationkey FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey")
def J04_validated_join(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return tables.one_to_one(counts, table(spark, d, "customer").select(C("c_custkey").alias("o_custkey"), "c_nationkey"), ["o_custkey"])


@query(f"""{E}, g AS (SELECT entity, day AS rday, max(event_id) AS signup FROM ev WHERE kind = 'signup' GROUP BY 1, 2)
    SELECT event_id, g.signup FROM (SELECT * FROM ev WHERE kind = 'purchase') l ASOF LEFT JOIN g ON l.entity = g.entity AND l.day > g.rday""")
def J08_asof_strict(spark, d):
    rows = events(spark, d)
    right = rows.filter("kind = 'signup'").select("entity", "day", C("event_id").alias("signup"))
    return history.asof_join(rows.filter("kind = 'purchase'").select("entity", "day", "event_id"), right, "entity", "day", ["signup"], "signup").select("event_id", "signup")


@query(f"""{E}, a AS (SELECT entity, day, string_agg(kind || '|' || CAST(event_id % 7 AS VARCHAR), ';' ORDER BY event_id) AS s FROM ev GROUP BY 1, 2),
    b AS (SELECT entity, day, string_agg(kind || '|' || CAST(event_id % 7 AS VARCHAR), ';' ORDER BY event_id) AS s FROM ev WHERE event_id % 13 <> 0 GROUP BY 1, 2),
    u AS (SELECT * FROM a QUALIFY count(*) OVER (PARTITION BY day, s) = 1), v AS (SELECT * FROM b QUALIFY count(*) OVER (PARTITION BY day, s) = 1)
    SELECT u.entity AS entity, v.entity AS other FROM u JOIN v ON u.day = v.day AND u.s = v.s""")
def J11_fingerprint_join(spark, d):
    rows = events(spark, d).withColumn("m", C("event_id") % 7)
    prints = lambda x, name: resolve.fingerprints(x, ["entity", "day"], ["kind", "m"], "event_id", "s").withColumnRenamed("entity", name)
    return resolve.matched_groups(prints(rows, "entity"), prints(rows.filter("event_id % 13 <> 0"), "other"), ["day", "s"], "entity", "other")


@query(f"{E}, g AS (SELECT entity AS who, day AS that_day, count(*) AS n FROM ev GROUP BY 1, 2) SELECT event_id, n FROM ev JOIN g ON entity = who AND day = that_day")
def J05_many_to_one(spark, d):
    rows = events(spark, d)
    games = rows.groupBy(C("entity").alias("who"), C("day").alias("that_day")).agg(F.count("*").alias("n"))
    return tables.matched(rows, games, {"entity": "who", "day": "that_day"}, unique=False).select("event_id", "n")


@query(f"{E}, b AS (SELECT entity AS who, event_id AS number, kind AS seen FROM ev WHERE event_id % 3 <> 0) SELECT event_id, kind, seen FROM ev JOIN b ON entity = who AND event_id = number")
def J06_composite_join(spark, d):
    rows = events(spark, d)
    other = rows.filter("event_id % 3 <> 0").select(C("entity").alias("who"), C("event_id").alias("number"), C("kind").alias("seen"))
    return tables.matched(rows.select("entity", "event_id", "kind"), other, {"entity": "who", "event_id": "number"}).select("event_id", "kind", "seen")


@query(f"""{E}, a AS (SELECT * FROM ev QUALIFY count(*) OVER (PARTITION BY entity, day, kind) = 1), b AS (SELECT * FROM ev WHERE event_id % 13 <> 0 QUALIFY count(*) OVER (PARTITION BY entity, day, kind) = 1)
    SELECT a.event_id AS event_id, b.event_id AS other FROM a JOIN b ON a.entity = b.entity AND a.day = b.day AND a.kind = b.kind""")
def J10_seed_join(spark, d):
    rows = events(spark, d).select("entity", "day", "kind", "event_id")
    return resolve.seed_join(rows, rows.filter("event_id % 13 <> 0").withColumnRenamed("event_id", "other"), ["entity", "day", "kind"]).select("event_id", "other")


@query(f"""{E}, w AS (SELECT entity, period, count(*) AS n FROM ev GROUP BY 1, 2), m AS (SELECT entity, period, {MIX} FROM ev WHERE kind IN ('click', 'view', 'purchase') AND event_id % 4 = 0 GROUP BY 1, 2)
    SELECT w.entity, w.period, n, mix_click, mix_view, mix_purchase FROM w LEFT JOIN m ON w.entity = m.entity AND w.period = m.period""")
def J12_pivot_join(spark, d):
    rows = events(spark, d)
    wide = history.sensor_profiles(rows, "entity", "period", [], "kind", "event_id").select("entity", "period", "n")
    return rounded(wide.join(history.mix_shares(rows.filter("event_id % 4 = 0"), ["entity", "period"], "kind", ["click", "view", "purchase"]), ["entity", "period"], "left"))


@query(f"""{BOARD}, b AS (SELECT CAST(entity AS VARCHAR) || '/' || CAST(period AS VARCHAR) AS name, CAST(entity AS VARCHAR) || '/' || CAST(period - 1 AS VARCHAR) AS ref, brier FROM board)
    SELECT b.name, round(b.brier, 6) AS brier, round(b.brier - r.brier, 6) AS delta, round((r.brier - b.brier) * 100 / r.brier, 4) AS improvement_pct FROM b LEFT JOIN b r ON b.ref = r.name""")
def M11_deltas(spark, d):
    named = _board(spark, d).select(F.concat_ws("/", "entity", "period").alias("name"), F.concat_ws("/", C("entity").cast("string"), (C("period") - 1).cast("string")).alias("ref"), "brier")
    return rounded(evaluate.paired_deltas(named, "name", "ref", "brier").withColumn("improvement_pct", F.round("improvement_pct", 4)))


@query(f"{E}, a AS (SELECT entity, value FROM ev WHERE kind = 'click'), b AS (SELECT entity, day FROM ev WHERE kind = 'signup') SELECT entity, value, CAST(NULL AS INT) AS day FROM a UNION ALL SELECT entity, NULL, day FROM b")
def U01_union_missing(spark, d):
    rows = events(spark, d)
    return rows.filter("kind = 'click'").select("entity", "value").unionByName(rows.filter("kind = 'signup'").select("entity", "day"), allowMissingColumns=True)


@query("""WITH o AS (SELECT event_id FROM events WHERE event_id % 2 = 0), d AS (SELECT event_id FROM events EXCEPT ALL SELECT event_id FROM o)
    SELECT NOT EXISTS (SELECT event_id FROM events EXCEPT ALL SELECT event_id FROM events) AS same_ids, NOT EXISTS (SELECT * FROM d) AS same_after_drop""")
def U04_set_equality(spark, d):
    ids = events(spark, d).select("event_id")
    same, other = tables.same_rows(ids, ids.select("event_id")), tables.same_rows(ids, ids.filter("event_id % 2 = 0"))
    return spark.range(1).select(F.lit(same).alias("same_ids"), F.lit(other).alias("same_after_drop"))


# --- history ----------------------------------------------------------------------------------------------------------------------


@query(f"""{W}, s AS (SELECT DISTINCT period FROM log), g AS (SELECT s.period, avg(y) AS g FROM s JOIN log ON log.period < s.period GROUP BY 1),
    pr AS (SELECT s.period, state, avg(y) AS pr FROM s JOIN log ON log.period < s.period GROUP BY 1, 2),
    h AS (SELECT s.period, entity, state, sum(y) AS t, count(*) AS n FROM s JOIN log ON log.period < s.period GROUP BY 1, 2, 3)
    SELECT entity, h.state, h.period, round((t + 50 * coalesce(pr, g)) / (n + 50), 6) AS rate, CAST(n AS BIGINT) AS n FROM h JOIN g USING (period) LEFT JOIN pr ON pr.period = h.period AND pr.state IS NOT DISTINCT FROM h.state""")
def A02_smoothed_rate(spark, d):
    return rounded(history.smoothed_rates(log(spark, d), ["entity", "state"], "period", "y", prior_keys=["state"]))


@query(f"""{W}, g AS (SELECT period + 1 AS period, avg(y) AS g FROM log GROUP BY 1), s AS (SELECT DISTINCT period FROM log),
    h AS (SELECT period + 1 AS period, entity, sum(y) AS t, count(*) AS n FROM log GROUP BY 1, 2)
    SELECT entity, h.period, round((t + 50 * g) / (n + 50), 6) AS rate, CAST(n AS BIGINT) AS n FROM h JOIN g USING (period) JOIN s USING (period)""")
def W02_prev_period(spark, d):
    return rounded(history.smoothed_rates(log(spark, d), ["entity"], "period", "y", frame=history.LAST))


def _recent_sql(n: int) -> str:
    return f"""{E}, per AS (SELECT DISTINCT entity, s.period FROM ev, (SELECT DISTINCT period FROM ev) s),
    j AS (SELECT per.entity, per.period, ev.y, row_number() OVER (PARTITION BY per.entity, per.period ORDER BY ev.period DESC, event_id DESC) AS k FROM per JOIN ev ON ev.entity = per.entity AND ev.period < per.period),
    g AS (SELECT s.period, avg(y) AS g FROM (SELECT DISTINCT period FROM ev) s JOIN ev ON ev.period < s.period GROUP BY 1)
    SELECT entity, j.period, round((sum(y) + 20 * any_value(g)) / (count(*) + 20), 6) AS rate, CAST(sum(y) AS BIGINT) AS total, count(*) AS n FROM j JOIN g USING (period) WHERE k <= {n} GROUP BY 1, 2"""


@query(_recent_sql(20))
def A04_recent20(spark, d):
    return rounded(history.recent_rates(events(spark, d), "entity", "period", "y", "event_id", 20))


@query(_recent_sql(50))
def A04_recent50(spark, d):
    return rounded(history.recent_rates(events(spark, d), "entity", "period", "y", "event_id", 50))


@query(_recent_sql(100))
def A04_recent100(spark, d):
    return rounded(history.recent_rates(events(spark, d), "entity", "period", "y", "event_id", 100))


@query(f"""{E}, s AS (SELECT DISTINCT period FROM ev), e AS (SELECT DISTINCT entity, period FROM ev WHERE kind = 'signup')
    SELECT entity, s.period, max(e.period) AS last_period, s.period - max(e.period) AS gap FROM s JOIN e ON e.period < s.period WHERE s.period IN (SELECT period FROM e) GROUP BY 1, 2""")
def A05_last_seen(spark, d):
    return history.last_seen(events(spark, d).filter("kind = 'signup'"), "entity", "period")


def _summary(spark, d, exactly=False):
    return history.sensor_summary(events(spark, d), "entity", "period", ["reading"], "kind", ["click", "view", "purchase"], exactly)


@query(f"""{E} SELECT entity, period, count(*) AS n_rows, {", ".join(f"count(*) FILTER (kind = '{k}') AS usage_{k}" for k in ("click", "view", "purchase"))}, count(*) FILTER (kind NOT IN ('click', 'view', 'purchase')) AS usage_other,
    count(reading) AS reading_n, round(coalesce(sum(reading), 0), 4) AS reading_sum, round(coalesce(sum(reading * reading), 0), 4) AS reading_squares FROM ev GROUP BY 1, 2""")
def A06_sensor_summary(spark, d):
    return rounded(_summary(spark, d), 4)


@query(f"{E} SELECT entity, period, round(avg(reading), 6) AS mean, round(stddev_pop(reading), 5) AS std FROM ev GROUP BY 1, 2")
def A07_moments(spark, d):
    mean, std = history.exact_moments(C("reading_n"), C("reading_sum"), C("reading_squares"))
    return _summary(spark, d, exactly=True).select("entity", "period", F.round(mean, 6).alias("mean"), F.round(std, 5).alias("std"))


@query(f"""{E}, p AS (SELECT DISTINCT period FROM ev), a AS (SELECT s.entity, p.period FROM (SELECT DISTINCT entity FROM ev) s, p)
    SELECT a.entity, a.period, round(avg(reading), 6) AS career_mean, round(stddev_pop(reading), 5) AS career_std, round(avg(reading) FILTER (ev.period = a.period - 1), 6) AS prev_mean,
    round(avg(reading) FILTER (ev.period = a.period - 1) - avg(reading) FILTER (ev.period < a.period - 1), 6) AS delta_mean
    FROM a JOIN ev ON ev.entity = a.entity AND ev.period < a.period GROUP BY 1, 2 HAVING count(reading) > 0""")
def W03_prev_vs_earlier(spark, d):
    return rounded(history.sensor_history(_summary(spark, d), "entity", "period", "reading").withColumn("career_std", F.round("career_std", 5)))


@query(f"{E} SELECT entity, period, count(*) AS n, round(avg(reading), 6) AS reading_mean, round(stddev_samp(reading), 6) AS reading_std, arg_min(kind, event_id) FILTER (kind <> 'view') AS first_kind FROM ev GROUP BY 1, 2")
def A08_sample_std(spark, d):
    return rounded(history.sensor_profiles(events(spark, d).withColumn("kind", F.when(C("kind") != "view", C("kind"))), "entity", "period", ["reading"], "kind", "event_id"))


@query(f"{E} SELECT entity, {MIX} FROM ev WHERE kind IN ('click', 'view', 'purchase') GROUP BY 1")
def A09_mix_pivot(spark, d):
    return rounded(history.mix_shares(events(spark, d), ["entity"], "kind", ["click", "view", "purchase"]))


# --- resolution -------------------------------------------------------------------------------------------------------------------

VOTES = f"{E}, v AS (SELECT entity, kind, count(*) AS votes FROM ev GROUP BY 1, 2), t AS (SELECT *, CAST(sum(votes) OVER (PARTITION BY entity) AS BIGINT) AS total FROM v)"


@query(f"{VOTES} SELECT entity, kind, votes, total, round(votes / total::DOUBLE, 6) AS purity FROM t")
def A10_votes(spark, d):
    return rounded(resolve.votes(events(spark, d), "entity", "kind"))


@query(f"{VOTES} SELECT entity, kind, votes, round(votes / total::DOUBLE, 6) AS purity FROM t QUALIFY row_number() OVER (PARTITION BY entity ORDER BY votes DESC, kind DESC) = 1")
def A11_argmax(spark, d):
    return rounded(resolve.winners(resolve.votes(events(spark, d), "entity", "kind"), "entity", "kind"))


@query(f"{VOTES} SELECT entity, kind FROM t QUALIFY row_number() OVER (PARTITION BY entity ORDER BY votes DESC, kind) = 1")
def A12_mode(spark, d):
    return resolve.most_common(events(spark, d), ["entity"], "kind")


@query(f"""{VOTES}, w AS (SELECT votes / total::DOUBLE AS p FROM t QUALIFY row_number() OVER (PARTITION BY entity ORDER BY votes DESC, kind DESC) = 1),
    a AS (SELECT count(p)::DOUBLE AS c, avg(p) AS m, stddev_samp(p) AS s, min(p) AS lo, max(p) AS hi, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.5) AS q2, quantile_cont(p, 0.75) AS q3 FROM w)
    SELECT unnest(['count', 'mean', 'std', 'min', '25%', '50%', '75%', 'max']) AS statistic, round(unnest([c, m, s, lo, q1, q2, q3, hi]), 6) AS value FROM a""")
def A27_describe(spark, d):
    return rounded(tables.described(resolve.winners(resolve.votes(events(spark, d), "entity", "kind"), "entity", "kind"), "purity"))


@query(f"{E} SELECT entity, day, string_agg(kind || '|' || CAST(event_id % 7 AS VARCHAR), ';' ORDER BY event_id) AS s FROM ev GROUP BY 1, 2")
def A13_sequence(spark, d):
    return events(spark, d).withColumn("m", C("event_id") % 7).groupBy("entity", "day").agg(resolve.sequence_text(["kind", "m"], "event_id").alias("s"))


SESSIONS = f"""{E}, m AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR day <> lag(day) OVER w OR kind < lag(kind) OVER w THEN 1 ELSE 0 END AS b FROM ev WINDOW w AS (PARTITION BY period ORDER BY event_id)),
    n AS (SELECT *, CAST(sum(b) OVER (PARTITION BY period ORDER BY event_id) AS BIGINT) AS session FROM m)"""


@query(f"{SESSIONS} SELECT event_id, period, session FROM n")
def W06_sessionize(spark, d):
    return resolve.sessions(events(spark, d), "period", "event_id", ["day"], ["kind"]).select("event_id", "period", "session")


@query(f"{SESSIONS} SELECT event_id, CAST(row_number() OVER (PARTITION BY period, session ORDER BY event_id) AS INT) AS place FROM n")
def W07_position(spark, d):
    return resolve.sessions(events(spark, d), "period", "event_id", ["day"], ["kind"]).select("event_id", "place")


@query(f"{E} SELECT event_id, row_number() OVER (ORDER BY event_id) AS _row_order FROM ev WHERE event_id % 3 <> 0")
def W13_row_order(spark, d):
    return with_row_order(events(spark, d).filter("event_id % 3 <> 0").select("event_id"), "event_id")


# --- cold start -------------------------------------------------------------------------------------------------------------------

OUTCOMES = f"{E}, o AS (SELECT entity, period, avg(y) AS rate, count(*) AS n, min(event_id % 40) = 0 AS rookie FROM ev GROUP BY 1, 2)"
FALLBACKS = f"""{OUTCOMES}, f AS (SELECT period + 1 AS period, quantile_cont(rate, 0.5) AS league, CASE WHEN count(*) FILTER (rookie) >= 3 THEN quantile_cont(rate, 0.5) FILTER (rookie) ELSE quantile_cont(rate, 0.5) END AS rookie_prior FROM o GROUP BY 1)"""
KNN = f"""{FALLBACKS}, pf AS (SELECT entity, period, count(*) AS size, avg(reading) AS m1, stddev_samp(reading) AS m2 FROM ev GROUP BY 1, 2 HAVING count(*) >= 5),
    st AS (SELECT period, median(m1) AS c1, quantile_cont(m1, 0.75) - quantile_cont(m1, 0.25) AS i1, median(m2) AS c2, quantile_cont(m2, 0.75) - quantile_cont(m2, 0.25) AS i2 FROM pf GROUP BY 1),
    z AS (SELECT pf.entity, pf.period, o.rate, (coalesce(m1, c1) - c1) / CASE WHEN i1 = 0 THEN 1 ELSE i1 END AS z1, (coalesce(m2, c2) - c2) / CASE WHEN i2 = 0 THEN 1 ELSE i2 END AS z2 FROM pf JOIN st USING (period) JOIN o ON o.entity = pf.entity AND o.period = pf.period),
    dd AS (SELECT a.entity, a.period, b.rate, sqrt(((a.z1 - b.z1) * (a.z1 - b.z1) + (a.z2 - b.z2) * (a.z2 - b.z2)) / 2) AS d, b.entity AS other FROM z a JOIN z b ON a.period = b.period AND a.entity <> b.entity),
    nn AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY entity, period ORDER BY d, other) <= 20),
    knn AS (SELECT entity, period + 1 AS period, sum(rate / greatest(d, 1e-6)) / sum(1 / greatest(d, 1e-6)) AS prior, sum(d / greatest(d, 1e-6)) / sum(1 / greatest(d, 1e-6)) AS distance FROM nn GROUP BY 1, 2)"""


def _outcomes(spark, d):
    return coldstart.outcomes(events(spark, d).withColumn("counter", C("event_id") % 40), "entity", "period", "y", "counter")


@query(f"{OUTCOMES} SELECT entity, period, round(rate, 6) AS rate, n, rookie FROM o")
def A14_outcomes(spark, d):
    return rounded(_outcomes(spark, d))


@query(f"{FALLBACKS} SELECT period, round(league, 6) AS league, round(rookie_prior, 6) AS rookie_prior FROM f")
def A15_fallbacks(spark, d):
    return rounded(coldstart.fallbacks(_outcomes(spark, d), "period"))


@query(f"{E} SELECT period, round(median(reading), 6) AS median, round(quantile_cont(reading, 0.25), 6) AS q1, round(quantile_cont(reading, 0.75), 6) AS q3 FROM ev GROUP BY 1")
def A16_robust_stats(spark, d):
    at = quantiles(events(spark, d), ["period"], ["reading"], [0.25, 0.5, 0.75])
    return rounded(at.select("period", C("reading")[1].alias("median"), C("reading")[0].alias("q1"), C("reading")[2].alias("q3")))


def _lookup(spark, d):
    rows = events(spark, d).withColumn("counter", C("event_id") % 40)
    profiles = rows.groupBy("entity", "period").agg(F.count("*").alias("size"), F.avg("reading").alias("m1"), F.stddev_samp("reading").alias("m2"))
    return coldstart.lookup(rows, profiles, "entity", "period", "y", "counter", ["m1", "m2"], "size", "size", coldstart.ColdStart(min_rows=5))


@query(f"{KNN} SELECT entity, period, round(prior, 5) AS prior, round(distance, 5) AS distance FROM knn")
def J09_knn(spark, d):
    return rounded(_lookup(spark, d).drop("neighbours"), 5)


@query(f"""{KNN}, q AS (SELECT event_id, entity, period, event_id % 3 AS n, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 1000 END AS rate FROM ev),
    c AS (SELECT q.*, n <= 0 OR rate IS NULL AS is_cold, prior, league, rookie_prior FROM q LEFT JOIN knn ON q.entity = knn.entity AND q.period = knn.period LEFT JOIN f ON q.period = f.period)
    SELECT event_id, is_cold, round(coalesce(prior, rookie_prior, league, 0.49), 5) AS cold_prior,
    CASE WHEN NOT is_cold THEN 'self_history' WHEN prior IS NOT NULL THEN 'knn' WHEN rookie_prior IS NOT NULL THEN 'rookie' WHEN league IS NOT NULL THEN 'league' ELSE 'constant' END AS cold_source,
    round(CASE WHEN is_cold THEN coalesce(prior, rookie_prior, league, 0.49) ELSE rate END, 5) AS rate FROM c""")
def C02_cold_attach(spark, d):
    rows = events(spark, d).select("event_id", "entity", "period", (C("event_id") % 3).alias("n"), F.when(C("event_id") % 5 != 0, C("value") / 1000).alias("rate"))
    out = coldstart.attach(rows, _lookup(spark, d), coldstart.fallbacks(_outcomes(spark, d), "period"), "entity", "period", "n", "rate")
    return rounded(out.select("event_id", "is_cold", "cold_prior", "cold_source", "rate"), 5)


# --- evaluation -------------------------------------------------------------------------------------------------------------------


@query(f"""{W}, q AS (SELECT period, y, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM log),
    a AS (SELECT period, count(*) AS n, avg((q - y) * (q - y)) AS brier, avg(-(y * ln(q) + (1 - y) * ln(1 - q))) AS ll, avg(y) AS r, avg(q) AS m, stddev_pop(q) AS s FROM q GROUP BY 1)
    SELECT period, n, round(brier, 6) AS brier, round(ll, 6) AS logloss, round(r, 6) AS target_rate, round(m, 6) AS prediction_mean, round(s, 6) AS prediction_std, round(CASE WHEN r * (1 - r) = 0 THEN 0 ELSE 100000 * (1 - brier / (r * (1 - r))) END, 3) AS skill FROM a""")
def A18_metrics(spark, d):
    return rounded(evaluate.metrics(log(spark, d), "y", "p", ["period"]).withColumn("skill", F.round("skill", 3)))


@query(f"""{W}, r AS (SELECT period, y, rank() OVER (PARTITION BY period ORDER BY p) + (count(*) OVER (PARTITION BY period, p) - 1) / 2.0 AS r FROM log)
    SELECT period, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM r GROUP BY 1""")
def A19_auc(spark, d):
    return rounded(evaluate.auc(log(spark, d), "y", "p", ["period"]))


BINS = f"{W}, b AS (SELECT {' + '.join(f'CASE WHEN p >= {e!r}::DOUBLE THEN 1 ELSE 0 END' for e in evaluate.EDGES)} AS bin, p, y FROM log), c AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, min(p) AS lo, max(p) AS hi FROM b GROUP BY 1)"


@query(f"{BINS} SELECT bin, n, round(mp, 6) AS mean_p, round(my, 6) AS mean_y, round(lo, 6) AS min_p, round(hi, 6) AS max_p, round(abs(mp - my), 6) AS gap FROM c")
def A20_calibration(spark, d):
    return rounded(evaluate.calibration(log(spark, d), "y", "p"))


@query(f"{BINS} SELECT round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM c")
def A20_calibration_error(spark, d):
    return rounded(evaluate.calibration_error(log(spark, d), "y", "p"))


PROFILED = ["balls", "outs", "li", "state", "base_state", "sensor_n"]


@query(W + " " + " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '__MISSING__') AS missing, round(count(*) FILTER ({c} IS NULL OR CAST({c} AS VARCHAR) = '__MISSING__') / count(*)::DOUBLE, 6) AS rate FROM log" for c in PROFILED))
def A21_missing_profile(spark, d):
    return rounded(tables.missing_profile(log(spark, d).select(*PROFILED)))


COMPARED = f"{W}, a AS (SELECT period, avg((p - y) * (p - y)) AS brier, avg(p) AS mean FROM log GROUP BY 1), b AS (SELECT period, avg((0.5 - y) * (0.5 - y)) AS brier, 0.5 AS mean FROM log GROUP BY 1), x AS (SELECT CAST(period AS VARCHAR) AS period, a.brier - b.brier AS brier, a.mean - b.mean AS mean FROM a JOIN b USING (period))"


@query(f"{COMPARED} SELECT period, round(brier, 6) AS brier, round(mean, 6) AS mean FROM x UNION ALL SELECT 'mean', round(avg(brier), 6), round(avg(mean), 6) FROM x")
def M12_compare(spark, d):
    rows = log(spark, d)
    score = lambda p: rows.groupBy("period").agg(F.avg((p - C("y")) ** 2).alias("brier"), F.avg(p).alias("mean"))
    return rounded(evaluate.compare_tables(score(C("p")), score(F.lit(0.5)), "period", ["brier", "mean"]))


@query(f"{W} SELECT period, round(avg(CASE WHEN batter_hand IS NOT NULL THEN 1 ELSE 0 END), 6) AS coverage FROM log GROUP BY 1")
def A23_coverage(spark, d):
    return rounded(history.coverage(log(spark, d), "period", "batter_hand"))


RANKED = f"{E}, g AS (SELECT entity, period, kind, count(*) AS n, stddev_samp(reading) AS s FROM ev GROUP BY 1, 2, 3), h AS (SELECT entity, period, kind, n, CASE WHEN n >= 3 THEN s END AS s FROM g), r AS (SELECT *, CASE WHEN s IS NOT NULL THEN (rank() OVER (PARTITION BY period, kind ORDER BY s NULLS LAST) + (count(s) OVER (PARTITION BY period, kind, s) - 1) / 2.0) / count(s) OVER (PARTITION BY period, kind) END AS pct FROM h)"
SCORED = f"{RANKED}, sc AS (SELECT *, 50 + ((1 - pct) * 100 - 50) * n / (n + 100.0) AS score FROM r)"


def _ranked(spark, d):
    return stability.ranked_deviations(events(spark, d), "entity", "period", "kind", "reading", 3)


@query(f"{RANKED} SELECT entity, period, kind, round(pct, 6) AS pct FROM r")
def W09_pct_rank(spark, d):
    return rounded(_ranked(spark, d).select("entity", "period", "kind", "pct"))


@query(f"{SCORED} SELECT entity, period, kind, round(score, 5) AS score FROM sc")
def W10_shrinkage(spark, d):
    return rounded(_ranked(spark, d).select("entity", "period", "kind", stability.shrunk_score(C("pct"), C("n")).alias("score")), 5)


def _scores(spark, d):
    return stability.weighted_scores(_ranked(spark, d), "entity", "period")


SPIN = f"{SCORED}, wt AS (SELECT *, n / sum(n) OVER (PARTITION BY entity, period) AS w FROM sc), fin AS (SELECT entity, period, coalesce(sum(w * score), 0) AS score, CAST(sum(n) AS BIGINT) AS n FROM wt GROUP BY 1, 2)"


@query(f"{SPIN} SELECT entity, period, round(score, 5) AS score, n FROM fin")
def A24_weighted_score(spark, d):
    return rounded(_scores(spark, d), 5)


@query(f"""{SPIN}, q AS (SELECT event_id, entity, period FROM ev WHERE kind = 'purchase')
    SELECT event_id, round(coalesce(score, -1), 5) AS score, CASE WHEN score IS NULL THEN 'D' WHEN n >= 10 THEN 'A' ELSE 'B' END AS grade FROM q ASOF LEFT JOIN fin ON q.entity = fin.entity AND q.period > fin.period""")
def M18_spin_score(spark, d):
    rows = events(spark, d).filter("kind = 'purchase'").select("entity", "period", "event_id")
    return rounded(stability.attach_scores(rows, _scores(spark, d), "entity", "period", "n", 10).select("event_id", "score", "grade"), 5)


@query(f"{W}, t AS (SELECT state, count(*) / (SELECT count(*) FROM log WHERE period < 2000)::DOUBLE AS f FROM log WHERE period < 2000 GROUP BY 1) SELECT {KEYS}, round(coalesce(f, 0), 6) AS freq FROM log LEFT JOIN t ON log.state IS NOT DISTINCT FROM t.state WHERE period >= 2000")
def A25_frequency_encode(spark, d):
    rows = log(spark, d)
    return rounded(models.frequency_encode(rows.filter("period < 2000"), rows.filter("period >= 2000"), "state").select(*KEY_COLUMNS, C("state_freq").alias("freq")))


@query(f"{W}, m AS (SELECT median(li) AS li, median(balls) AS balls FROM log WHERE period < 2000) SELECT {KEYS}, round(coalesce(log.li, m.li), 7) AS li, CAST(coalesce(log.balls, m.balls) AS DOUBLE) AS balls FROM log, m WHERE period >= 2000")
def A26_median_impute(spark, d):
    rows = log(spark, d)
    fill = models.medians(rows.filter("period < 2000"), ["li", "balls"])
    return rounded(rows.filter("period >= 2000").select(*KEY_COLUMNS, *[F.coalesce(C(c).cast("double"), F.lit(v)).alias(c) for c, v in fill.items()]), 7)


@query(f"{BOARD}, h AS (SELECT CAST(entity % 20 AS VARCHAR) AS experiment, period, entity, brier FROM board) SELECT experiment, round(brier, 6) AS brier, period FROM h QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY period DESC, entity DESC) = 1")
def W11_latest(spark, d):
    runs = _board(spark, d).withColumns({"experiment": (C("entity") % 20).cast("string"), "at": F.struct("period", "entity")})
    return rounded(evaluate.latest(runs, ["experiment"], "at").select("experiment", "brier", "period"))


@query(f"{E} SELECT entity, kind, event_id, 'first' AS which FROM ev QUALIFY row_number() OVER (PARTITION BY entity, kind ORDER BY event_id) = 1 UNION ALL SELECT entity, kind, event_id, 'last' FROM ev QUALIFY row_number() OVER (PARTITION BY entity, kind ORDER BY event_id DESC) = 1")
def W12_dedup(spark, d):
    rows = events(spark, d).select("entity", "kind", "event_id")
    first, last = (tables.first_per_key(rows, ["entity", "kind"], o).withColumn("which", F.lit(n)) for n, o in (("first", C("event_id").asc()), ("last", C("event_id").desc())))
    return first.unionByName(last)


@query(f"{BOARD} SELECT entity, period, round(brier, 6) AS brier FROM board ORDER BY board.brier, entity, period LIMIT 30")
def O03_topn(spark, d):
    return rounded(tables.top(_board(spark, d), 30, "brier", "entity", "period"))


@query(f"{E} SELECT entity, kind, event_id FROM ev")
def O01_stable_sort(spark, d):
    return tables.ordered(events(spark, d).select("kind", "entity", "event_id"), C("kind").desc(), "entity")


@query(f"""{RUNS}, c AS (SELECT * FROM runs WHERE status = 'success' AND data_signature = 's1' QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY finished_at DESC) = 1)
    SELECT experiment, round(brier, 6) AS brier FROM c""")
def O02_leaderboard(spark, d):
    return rounded(evaluate.leaderboard(_runs(spark, d), {"data_signature": "s1"}).select("experiment", "brier"))


@query(f"{RUNS} SELECT preprocessing_stage, finished_at, round(brier, 6) AS brier FROM runs WHERE model_family = 'boosted'")
def O05_stages(spark, d):
    return rounded(report.stage_comparison(_runs(spark, d), ["boosted"]).select("preprocessing_stage", "finished_at", "brier"))


@query(f"{RUNS} SELECT experiment, elapsed_seconds, round(brier, 6) AS brier FROM runs")
def S14_score_against_time(spark, d):
    return rounded(report.score_against_time(_runs(spark, d)))


@query(f"{RUNS} SELECT finished_at, round(brier, 6) AS brier FROM runs WHERE model_family = 'boosted' AND preprocessing_stage = 'stage2'")
def O05_final_stage(spark, d):
    return rounded(report.final_stage(_runs(spark, d), ["boosted"], "stage2").select("finished_at", "brier"))


@query(f"""{RUNS}, c AS (SELECT * FROM runs WHERE status = 'success' AND data_signature = 's0' QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY finished_at DESC) = 1),
    b AS (SELECT min(brier) AS base FROM c WHERE experiment = '1')
    SELECT experiment, round(brier - base, 6) AS brier_delta_vs_baseline, round((base - brier) * 100 / base, 4) AS brier_improvement_pct FROM c, b""")
def M11_baseline_deltas(spark, d):
    board = report.baseline_deltas(evaluate.leaderboard(_runs(spark, d), {"data_signature": "s0"}), "1")
    return rounded(board.select("experiment", "brier_delta_vs_baseline", F.round("brier_improvement_pct", 4).alias("brier_improvement_pct")))


@query(f"{BOARD} SELECT entity, period, round(brier, 6) AS brier FROM board QUALIFY row_number() OVER (PARTITION BY period ORDER BY board.brier, entity) <= 3")
def O04_group_topk(spark, d):
    return rounded(tables.top_per_group(_board(spark, d), ["period"], 3, "brier", "entity"))


@query(f"{E} SELECT entity, kind, count(*) AS n, round(avg(value), 8) AS mean FROM ev GROUP BY 1, 2 UNION ALL SELECT entity, 'mean', count(*), round(avg(value), 8) FROM ev GROUP BY 1")
def A22_mean_row(spark, d):
    rows = events(spark, d)
    totals = rows.rollup("entity", "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.grouping_id().alias("g")).filter("g < 3")
    return rounded(totals.select("entity", F.when(C("g") == 1, "mean").otherwise(C("kind")).alias("kind"), "n", "mean"), 8)


# --- models, exports, samples ---------------------------------------------------------------------------------------------------------

RESIDUAL = f"{W}, r AS (SELECT *, CAST(runners AS DOUBLE) AS a, CAST(strikes AS DOUBLE) AS b, y - p AS res FROM log)"


@query(f"""{RESIDUAL}, m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(res) AS mr FROM r WHERE period < 2000),
    s AS (SELECT sum((a - ma) * (a - ma)) + 10 AS aa, sum((b - mb) * (b - mb)) + 10 AS bb, sum((a - ma) * (b - mb)) AS ab, sum((a - ma) * (res - mr)) AS ar, sum((b - mb) * (res - mr)) AS br FROM r, m WHERE period < 2000),
    c AS (SELECT (bb * ar - ab * br) / (aa * bb - ab * ab) AS ca, (aa * br - ab * ar) / (aa * bb - ab * ab) AS cb FROM s)
    SELECT {KEYS}, round(ca * (a - ma) + cb * (b - mb) + mr, 6) AS correction FROM r, m, c WHERE period >= 2000""")
def M15_ridge(spark, d):
    rows = log(spark, d).select(*KEY_COLUMNS, "period", C("runners").cast("double").alias("a"), C("strikes").cast("double").alias("b"), (C("y") - C("p")).alias("residual"))
    model = models.ridge(rows.filter("period < 2000"), ["a", "b"], "residual", 10.0)
    return rounded(rows.filter("period >= 2000").select(*KEY_COLUMNS, model.correction().alias("correction")))


DESIGN = f"""{W}, t AS (SELECT median(li) AS med FROM log WHERE period < 2000), f AS (SELECT *, coalesce(li, med) AS x, coalesce(state, '__MISSING__') AS v FROM log, t),
    w AS (SELECT *, {", ".join(f"CAST(v = '{v}' AS INT)::DOUBLE AS i_{k}" for v, k in (("F", "f"), ("O", "o"), ("__MISSING__", "m")))} FROM f),
    g AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ("x", "i_f", "i_o", "i_m"))} FROM w WHERE period < 2000)"""


@query(f"""{DESIGN} SELECT {KEYS}, {", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} < 1e-6 THEN 1 ELSE s_{c} END, 5) AS {n}" for c, n in (("x", "z_li"), ("i_f", "z_state_F"), ("i_o", "z_state_O"), ("i_m", "z_state___MISSING__")))},
    round(least(greatest(p, 1e-5), 1 - 1e-5), 6) AS z_p, round(ln(least(greatest(p, 1e-5), 1 - 1e-5) / (1 - least(greatest(p, 1e-5), 1 - 1e-5))), 5) AS z_logit FROM w, g WHERE period >= 2000""")
def M13_residual_design(spark, d):
    rows = log(spark, d)
    design = models.residual_design(rows.filter("period < 2000"), ["li"], ["state"])
    return rounded(rows.filter("period >= 2000").select(*KEY_COLUMNS, *[x.alias(n) for n, x in design.columns("p").items()]), 5).withColumn("z_p", F.round("z_p", 6))


@query()
def M14_residual_correction(spark, d):
    rows = log(spark, d)
    model = models.residual_model(rows.filter("period < 2000"), ["li", "runners"], ["state"], "p", "y", 10.0)
    return rows.filter("period >= 2000").select(*KEY_COLUMNS, model.correction("p").alias("correction"))


@query(f"{W}, c AS (SELECT avg(y) AS c FROM log WHERE period < 2000) SELECT {KEYS}, round(c, 6) AS p FROM log, c WHERE period = 2000")
def M01_constant_rate(spark, d):
    rows = log(spark, d)
    return rounded(models.fit_configured({"type": "constant"}, rows.filter("period < 2000"), [], [], "y").predict(rows.filter("period = 2000")).select(*KEY_COLUMNS, "p"))


def _fold_sql(periods: list[int]) -> str:
    """Brier score of a constant forecast by the earlier periods' rate."""
    one = "SELECT {v} AS period, count(*) AS n, round(avg((y - c) * (y - c)), 6) AS brier, CAST((SELECT count(*) FROM log WHERE period < {v}) AS BIGINT) AS train_n FROM log, (SELECT avg(y) AS c FROM log WHERE period < {v}) WHERE period = {v}"
    return f"{W} " + " UNION ALL ".join(one.format(v=v) for v in periods)


@query(_fold_sql([1998, 1999, 2000]))
def M08_forward_folds(spark, d):
    rows = log(spark, d).select("period", "y")
    _, folds = validate.forward_folds(rows, {"type": "constant"}, [], [], "period", [1900, 1998, 1999, 2000], "y")
    return rounded(folds.select("period", "n", "brier", "train_n"))


def _ridge_sql(periods: list[int]) -> str:
    """Brier score of a line through the earlier periods' outcomes, its slope drawn to 0 by alpha = 3."""
    one = """SELECT {v} AS period, count(*) AS n, round(avg((y - p) * (y - p)), 6) AS brier, any_value(train_n) AS train_n FROM (
        SELECT y, train_n, least(greatest(my + sxy / (sxx + 3) * (p0 - mx), 0), 1) AS p FROM (SELECT y, p AS p0 FROM log WHERE period = {v}),
        (SELECT avg(y) AS my, avg(p) AS mx, covar_pop(p, y) * count(*) AS sxy, var_pop(p) * count(*) AS sxx, count(*) AS train_n FROM log WHERE period < {v}))"""
    return f"{W} " + " UNION ALL ".join(one.format(v=v) for v in periods)


RIDGE = {"type": "ridge", "params": {"alpha": 3.0}}


@query(_ridge_sql([1996, 1998, 2000]))
def M08_forward_ridge(spark, d):
    rows = log(spark, d).select("period", "y", C("p").alias("x"))
    _, folds = validate.forward_folds(rows, RIDGE, ["x"], [], "period", [1996, 1998, 2000], "y")
    return rounded(folds.select("period", "n", "brier", "train_n"))


@query(_ridge_sql([2000]))
def M09_refit_ridge(spark, d):
    rows = log(spark, d).select("period", "y", C("p").alias("x"))
    _, forecast, found = validate.tune_refit_evaluate(rows, RIDGE | {"refit_after_tuning": True}, ["x"], [], "period", 2000, "y")
    return rounded(evaluate.metrics(forecast, "y", "p", ["period"]).select("period", "n", "brier", F.lit(found["train_n"]).cast("long").alias("train_n")))


@query()
def M08_forward_boosted(spark, d):
    """Scores of each fold's second-order trees, grown side by side; tests/test_trees.py has their plain form."""
    rows = log(spark, d).select("period", "y", C("p").alias("x"), "li", "state")
    config = {"type": "second_order", "params": {"rounds": 4, "depth": 3, "rate": 0.3, "bins": 32, "rows_share": 1.0, "features_share": 1.0}}
    _, folds = validate.forward_folds(rows, config, ["x", "li", "state"], ["state"], "period", [1998, 1999, 2000], "y")
    return folds.select("period", "n", "brier", "auc", "ece", "train_n", "best_iteration")


def _learned(spark, d, config: dict):
    rows = log(spark, d).select(*KEY_COLUMNS, "period", "y", C("p").alias("q"), "li", "state", C("other").alias("batter"))
    model = models.fit_configured(config, rows.filter("period < 2000"), ["q", "li", "state", "batter"], ["state", "batter"], "y")
    return model.predict(rows.filter("period >= 2000")).select(*KEY_COLUMNS, C("p").alias("forecast"))


@query()
def M02_leaf_wise(spark, d):
    return _learned(spark, d, {"type": "leaf_wise", "params": {"rounds": 4, "leaves": 8, "rate": 0.2, "bins": 32}})


@query()
def M05_extra_trees(spark, d):
    return _learned(spark, d, {"type": "extra_trees", "params": {"trees": 6, "depth": 4, "seed": 1}})


@query()
def M06_second_order(spark, d):
    return _learned(spark, d, {"type": "second_order", "params": {"rounds": 4, "depth": 4, "rate": 0.2, "bins": 32}})


@query()
def M07_ordered(spark, d):
    return _learned(spark, d, {"type": "ordered", "params": {"rounds": 4, "depth": 4, "rate": 0.2, "bins": 32}})


@query(_fold_sql([2000]))
def M09_tune_refit(spark, d):
    rows = log(spark, d).select("period", "y")
    _, forecast, found = validate.tune_refit_evaluate(rows, {"type": "constant", "refit_after_tuning": True}, [], [], "period", 2000, "y")
    return rounded(evaluate.metrics(forecast, "y", "p", ["period"]).select("period", "n", "brier", F.lit(found["train_n"]).cast("long").alias("train_n")))


@query()
def M02_boosted(spark, d):
    """Trees chosen on the period before, fitted to all earlier ones, forecasts of the last."""
    rows = log(spark, d).select(*KEY_COLUMNS, "period", "y", "p", "li", "state", C("runners").cast("double").alias("a"))
    config = {"type": "boosted", "refit_after_tuning": True, "params": {"maxIter": 6, "maxDepth": 3, "seed": 1}}
    return validate.tune_refit_evaluate(rows, config, ["a", "p", "li", "state"], ["state"], "period", 2000, "y")[1].select(*KEY_COLUMNS, C("p").alias("forecast"))


@query()
def M05_forest(spark, d):
    rows = log(spark, d).select(*KEY_COLUMNS, "period", "y", C("p").alias("q"), "li", "state")
    model = models.fit_configured({"type": "forest", "params": {"numTrees": 5, "seed": 1}}, rows.filter("period < 2000"), ["q", "li", "state"], ["state"], "y")
    return model.predict(rows.filter("period >= 2000")).select(*KEY_COLUMNS, C("p").alias("forecast"))


@query()
def M03_logistic(spark, d):
    rows = log(spark, d).select(*KEY_COLUMNS, "period", "y", "p", "li", "state", C("runners").cast("double").alias("a"))
    model = models.fit_configured({"type": "logistic"}, rows.filter("period < 2000").withColumnRenamed("p", "q"), ["a", "q", "li", "state"], ["state"], "y")
    return model.predict(rows.filter("period >= 2000").withColumnRenamed("p", "q")).select(*KEY_COLUMNS, C("p").alias("forecast"))


MATRIX = {
    "feature_sets": {"plain": {}, "mixed": {"blocks": ["mix"], "preprocessing_stage": "rowwise"}, "broken": {"blocks": ["nothing"]}},
    "models": {"rate": {"type": "constant"}},
    "baseline_experiment": "first",
    "experiments": [{"name": "first", "feature_set": "plain", "model": "rate"}, {"name": "second", "feature_set": "mixed", "model": "rate", "comparison_experiment": "first"}, {"name": "third", "feature_set": "broken", "model": "rate"}],
}


@query(f"{W}, b AS (SELECT round(avg((y - c) * (y - c)), 6) AS brier, count(*) AS n FROM log, (SELECT avg(y) AS c FROM log WHERE period < 2000) WHERE period = 2000) SELECT experiment, brier, n AS valid_n, 0.0::DOUBLE AS brier_delta_vs_baseline, comparison FROM b, (VALUES ('first', NULL), ('second', 0.0::DOUBLE)) AS t(experiment, comparison)")
def M10_matrix(spark, d):
    rows = log(spark, d).withColumn("row_id", scalars.composite_key(*map(C, KEY_COLUMNS)))
    board = lab.run_matrix(spark, MATRIX, {"v1": lab.View(rows, ["li", "p0"])}, work_folder(spark), 2000)
    return rounded(board.select("experiment", "brier", "valid_n", "brier_delta_vs_baseline", C("brier_delta_vs_comparison").alias("comparison")))


@query(f"{W} SELECT {KEYS}, round(least(greatest(p - 0.3, 1e-5), 1 - 1e-5), 6) AS p FROM log WHERE period = 2000")
def M17_submission(spark, d):
    rows = log(spark, d).filter("period = 2000").select(F.struct(*KEY_COLUMNS).alias("row_id"), (C("p") - 0.3).alias("p"))
    return rounded(validate.submission(rows, "row_id").select("row_id.*", "p"))


EXPORTED = ["li", "state", "balls", "sensor_n"]


def _bundle(spark, d):
    rows = scalars.finalize(log(spark, d).select(*KEY_COLUMNS, "period", "y", *EXPORTED), ["state"], [*KEY_COLUMNS, "period", "y"])
    rows = rows.withColumn("row_id", scalars.composite_key(*map(C, KEY_COLUMNS))).withColumn("is_train", C("period") < 2000)
    return export.Bundle(rows.withColumn("y", F.when(C("is_train"), C("y"))), EXPORTED, ["state"])


@query(f"{W} SELECT {' || chr(124) || '.join(f'CAST({k} AS VARCHAR)' for k in KEY_COLUMNS)} AS row_id, y, CAST(li AS FLOAT) AS li, coalesce(state, '__MISSING__') AS state, CAST(balls AS FLOAT) AS balls, CAST(sensor_n AS FLOAT) AS sensor_n FROM log WHERE period < 2000")
def M19_export_matrix(spark, d):
    return export.export_matrix(_bundle(spark, d), True)


@query(f"{W} " + " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS feature, count(*) FILTER ({c} IS NULL AND period < 2000) AS train_missing_n, round(count(*) FILTER ({c} IS NULL AND period < 2000) / count(*) FILTER (period < 2000)::DOUBLE, 6) AS train_missing_rate, count(*) FILTER ({c} IS NULL AND period >= 2000) AS test_missing_n, {'TRUE' if c == 'state' else 'FALSE'} AS is_categorical FROM log" for i, c in enumerate(EXPORTED, 1)))
def M19_schema(spark, d):
    return rounded(export.feature_schema(_bundle(spark, d)).select("position", "feature", "train_missing_n", "train_missing_rate", "test_missing_n", "is_categorical"))


@query(f"{E} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY period ORDER BY md5('7/' || CAST(event_id AS VARCHAR)), event_id) <= 100")
def S05_sample(spark, d):
    return tables.sample_per_group(events(spark, d), "period", "event_id", 100, 7)
