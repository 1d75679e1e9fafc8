"""Semantics that the SQL comparison over the driver's tables can't show: nulls, ties, leakage, errors, files."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.operators import blocks, coldstart, evaluate, export, history, lab, models, ranges, report, resolve, stability, tables, trees, validate
from tidemark.sources import files

C = F.col


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_numbers_drop_nan_infinity_and_text(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("Infinity",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(scalars.number(C("v"))).collect()] == [1.5, None, None, None, None]


def test_identifier_strips_a_float_tail(spark):
    assert spark.createDataFrame([("12.0",), ("12.05",)], "v string").select(scalars.identifier(C("v"))).collect() == [("12",), ("12.05",)]


def test_missing_predicates_are_false(spark):
    df = spark.createDataFrame([(None, 2), (3, 2), (1, None)], "balls int, strikes int").withColumns(blocks.count_flags())
    assert [tuple(r)[2:] for r in df.collect()] == [(0, 0, 1, 0, 0), (0, 1, 1, 1, 1), (0, 0, 0, 0, 0)]
    assert [r[0] for r in df.select(blocks.count_state()).collect()] == [None, "3-2", None]


def test_trends(spark):
    values = {"prev1_success": 0.70, "prev3_success": 0.62, "prev5_success": 0.55, "prev1_middle": 0.48, "prev3_middle": 0.43, "prev5_middle": 0.39, "pitcher_success": 0.60, "pitcher_middle": 0.40, "batter_success": 0.51, "batter_middle": 0.36, "pitcher_strike": 0.58, "pitcher_ball": 0.42}
    schema = ", ".join(f"{k} double" for k in values)
    got = spark.createDataFrame([tuple(values.values()), (None,) * len(values)], schema).select(*[c.alias(n) for n, c in blocks.trends().items()]).collect()
    assert len(blocks.trends()) == 13
    assert got[0]["success_trend_1v5"] == pytest.approx(0.15) and got[0]["middle_trend_3v5"] == pytest.approx(0.04)
    assert got[0]["success_batter_gap"] == pytest.approx(0.09) and got[0]["strike_ball_gap"] == pytest.approx(0.16) and got[0]["success_trend_sources"] == 3
    assert got[1]["success_trend_1v5"] is None and got[1]["success_trend_sources"] == 0


def test_threat_ignores_impossible_rates_and_missing_hands(spark):
    df = spark.createDataFrame([("R", "R", 0.6, 1.2, 0.4, 0.42, 0.5), (None, "L", 0.6, 0.2, 0.4, 0.42, 0.5), ("__MISSING__", "L", 0.6, 0.2, 0.4, 0.42, 0.5)], "pitcher_hand string, batter_hand string, pitcher_success double, pitcher_reverse double, pitcher_middle double, pitcher_ball double, batter_success double")
    got = df.select(*[c.alias(n) for n, c in blocks.threat().items()]).collect()
    assert [r["hand_match"] for r in got] == [1.0, None, None]
    assert [r["reverse_x_middle"] for r in got] == [None, pytest.approx(0.08), pytest.approx(0.08)]


def test_mix_with_missing_parts(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2, 9), (None, 0.3, None, 0), (None, None, None, None), (0.0, 0.0, 0.0, 1)], "fastball double, breaking double, offspeed double, mix_n int")
    got = df.select(*[c.alias(n) for n, c in blocks.mix().items()]).collect()
    assert got[0]["mix_entropy"] == pytest.approx(-sum(p * math.log(p) for p in (0.5, 0.3, 0.2)))
    assert (got[1]["mix_entropy"], got[1]["mix_dominant"], got[1]["mix_sum"]) == (0.0, 0.3, 0.3)
    assert (got[2]["mix_sum"], got[2]["mix_available"], got[3]["mix_entropy"]) == (None, 0, None)


def test_feature_sets(spark):
    df = spark.createDataFrame([(0.5, 0.3, 0.2, 9)], "fastball double, breaking double, offspeed double, mix_n int")
    out, kinds, report = blocks.apply_feature_set(df, ["mix"], drop=["mix_*_*", "fastball"])
    assert "mix_fastball_breaking" not in out.columns and "fastball" not in out.columns and "mix_entropy" in out.columns and kinds == []
    assert report["columns"] == len(out.columns)
    for bad in (lambda: blocks.apply_feature_set(df, ["mix"], drop=["tm_*"]), lambda: blocks.apply_feature_set(df, ["nothing"]), lambda: blocks.apply_feature_set(out.withColumn("fastball", F.lit(1.0)), ["mix"]), lambda: blocks.apply_feature_set(df, ["threat"])):
        with pytest.raises(ValueError):
            bad()
    assert blocks.feature_catalog(spark).count() == 45


LOG = [(10, 2019, 1, "a"), (10, 2019, 0, "a"), (10, 2020, 1, "b"), (20, 2020, 0, None), (None, 2019, 1, None), (10, 2022, 1, "a")]


def event_log(spark, data=LOG):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(data)], "entity int, period int, y int, state string, n int")


def test_strict_prior_without_smoothing(spark):
    got = {(e, p): (r, n) for e, p, r, n in rows(history.smoothed_rates(event_log(spark), ["entity"], "period", "y", m=0.0))}
    assert got[10, 2020] == (0.5, 2) and got[10, 2022] == (pytest.approx(2 / 3), 3)
    assert (20, 2020) not in got and got[None, 2020] == (1.0, 1)


def test_no_future_label_changes_a_feature(spark):
    changed = [(e, p, 1 - y if p >= 2020 else y, s) for e, p, y, s in LOG]
    for f in (
        lambda x: history.smoothed_rates(x, ["entity", "state"], "period", "y", prior_keys=["state"]),
        lambda x: history.recent_rates(x, "entity", "period", "y", "n", 2),
        lambda x: history.smoothed_rates(x, ["entity"], "period", "y", frame=history.LAST),
    ):
        old, new = (sorted(rows(f(event_log(spark, d)).filter("period <= 2020")), key=repr) for d in (LOG, changed))
        assert old == new and old


def test_recent_rates_leave_rows_without_key_out(spark):
    assert {r[0] for r in rows(history.recent_rates(event_log(spark), "entity", "period", "y", "n", 20))} == {10, 20}


def test_last_seen_over_a_gap(spark):
    assert (10, 2022, 2020, 2) in rows(history.last_seen(event_log(spark), "entity", "period"))


def test_sensor_history_uses_earlier_periods_only(spark):
    readings = spark.createDataFrame([("900", 2019, "fast", 140.0), ("900", 2020, "slow", 150.0), ("900", 2020, None, None), (None, 2020, "fast", 1.0)], "id string, period int, kind string, speed double")
    summary = history.sensor_summary(readings, "id", "period", ["speed"], "kind", ["fast"])
    assert [(r["period"], r["usage_fast"], r["usage_other"], r["speed_n"]) for r in summary.orderBy("period").collect()] == [(2019, 1, 0, 1), (2020, 0, 2, 1)]
    assert rows(history.sensor_history(summary, "id", "period", "speed")) == [("900", 2020, 140.0, 0.0, 140.0, None)]


def test_exact_moments_do_not_depend_on_the_order(spark):
    """A mean halfway between two rounded values, and a deviation of 0, from as many tasks and orders as one likes."""
    values = [0.1] * 27 + [70.73, 29.27, 0.31, 8.81, 61.01]  # mean 5.4009375
    readings = [("a", 1, v) for v in values] + [("b", 1, 500.3)] * 7 + [("c", 1, None)]
    found = set()
    for seed, parts in ((1, 1), (2, 3), (3, 7), (4, 16)):
        rows = spark.createDataFrame(readings, "k string, period int, v double").orderBy(F.rand(seed)).repartition(parts).withColumn("kind", F.lit("x"))
        mean, std = history.exact_moments(F.col("v_n"), F.col("v_sum"), F.col("v_squares"))
        at = history.sensor_summary(rows, "k", "period", ["v"], "kind", ["x"], exactly=True).select("k", F.round(mean, 6).alias("m"), std.alias("s")).orderBy("k")
        found.add(tuple(tuple(r) for r in at.collect()))
    ((a, b, c),) = found
    assert a[1] == 5.400938 and b[1:] == (500.3, 0.0) and c[1:] == (None, None)
    wild = spark.createDataFrame([("a", 1, 1e-30), ("a", 1, 1e30)], "k string, period int, v double").withColumn("kind", F.lit("x"))
    assert history.sensor_summary(wild, "k", "period", ["v"], "kind", ["x"], exactly=True).first().v_sum == 1e30


def test_equal_deviations_share_a_rank(spark):
    """Entities with the same readings in other orders and tasks, and with readings that don't vary, are ties."""
    some = [29.27, 122.79, 2.11, 0.3, 77.77, 15.01, 8.8]
    rows = [(e, 1, "x", some[(i * (e % 6 + 1) + e) % 7]) for e in range(60) for i in range(7)] + [(e, 1, "x", 0.1 * e) for e in range(100, 110) for _ in range(9)]
    at = stability.ranked_deviations(spark.createDataFrame(rows, "e int, p int, kind string, v double").repartition(13, F.rand(5)), "e", "p", "kind", "v", 3)
    assert {(r.pct, r.s == 0) for r in at.select("pct", "s").distinct().collect()} == {(5.5 / 70, True), (40.5 / 70, False)}


def test_exact_deviations_equal_spark_s(spark):
    from tidemark.functions import exact

    rows = spark.range(4000).select((F.col("id") % 40).alias("g"), F.round(F.rand(3) * 500, 2).alias("v")).unionByName(spark.sql("SELECT 100L AS g, 3.5D AS v UNION ALL SELECT 101L, 1e20D UNION ALL SELECT 101L, 2e20D UNION ALL SELECT 102L, CAST(NULL AS DOUBLE)"))
    for r in rows.groupBy("g").agg(exact.stddev_samp(F.col("v")).alias("a"), F.stddev_samp("v").alias("b")).collect():
        assert r.a == r.b or r.a == pytest.approx(r.b, rel=1e-11)


def test_asof_is_strict_and_takes_the_last_of_ties(spark):
    left = spark.createDataFrame([("a", 1), ("a", 3), ("b", 3), (None, 3)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10, 1), ("a", 1, 11, 2), ("a", 3, 12, 3), (None, 1, 9, 4)], "k string, t int, v int, o int")
    assert sorted(rows(history.asof_join(left, right, "k", "t", ["v"], "o")), key=repr) == sorted([("a", 1, None), ("a", 3, 11), ("b", 3, None), (None, 3, None)], key=repr)


def test_sessions_break_at_missing_values(spark):
    df = spark.createDataFrame([(1, 1, "x", 1), (1, 2, "x", 2), (1, 3, None, 2), (1, 4, "x", 3), (1, 5, "x", None), (1, 6, "x", 1), (2, 7, "x", 1)], "p int, n int, c string, f int")
    assert [(r["n"], r["session"], r["place"]) for r in resolve.sessions(df, "p", "n", ["c"], ["f"]).orderBy("n").collect()] == [(1, 1, 1), (2, 1, 2), (3, 2, 1), (4, 3, 1), (5, 3, 2), (6, 3, 3), (7, 1, 1)]


def test_votes_and_winner_of_a_tie(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("t", 1), ("t", 1), ("t", 3)], "s string, e int")
    assert sorted(rows(resolve.winners(resolve.votes(df, "s", "e"), "s", "e"))) == [("s", 2, 1, 0.5), ("t", 1, 2, pytest.approx(2 / 3))]


def test_one_to_one_raises(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(1, 2), (1, 3)], "k int, y int")
    with pytest.raises(ValueError):
        tables.one_to_one(a, b, ["k"])
    assert tables.one_to_one(a, b.filter("y = 2"), ["k"]).count() == 1


def test_cold_start_sources(spark):
    data = spark.createDataFrame([(1, 2020, 0, None), (2, 2020, None, 0.5), (3, 2021, 0, 0.4), (3, 2020, 5, 0.3)], "entity int, period int, n int, rate double")
    found = spark.createDataFrame([(1, 2020, 0.6)], "entity int, period int, prior double")
    back = spark.createDataFrame([(2020, 0.4, None)], "period int, league double, rookie_prior double")
    got = {(r["entity"], r["period"]): (r["cold_source"], r["rate"]) for r in coldstart.attach(data, found, back, "entity", "period", "n", "rate").collect()}
    assert got == {(1, 2020): ("knn", 0.6), (2, 2020): ("league", 0.4), (3, 2021): ("constant", 0.49), (3, 2020): ("self_history", 0.3)}


def test_neighbours_exclude_oneself(spark):
    log = spark.createDataFrame([(e, 2020, y, 0) for e, ys in ((1, (1, 1)), (2, (0, 0)), (3, (1, 0))) for y in ys], "e int, p int, y int, c int")
    profiles = spark.createDataFrame([(1, 2020, 60, 1.0, None), (2, 2020, 60, 2.0, None), (3, 2020, 10, 9.0, None), (1, 2020, 55, 7.0, None)], "e int, p int, n int, m double, void_metric double")
    got = rows(coldstart.lookup(log, profiles, "e", "p", "y", "c", ["m"], "n", "n"))
    assert sorted((e, p, prior, n) for e, p, prior, _, n in got) == [(1, 2021, 0.0, 1), (2, 2021, 1.0, 1)]
    assert rows(coldstart.lookup(log, profiles, "e", "p", "y", "c", ["void_metric"], "n", "n")) == []


def test_a_neighbour_without_a_rate_takes_no_place(spark):
    log = spark.createDataFrame([(1, 2020, 1, 0), (2, 2020, None, 0), (3, 2020, 0, 0), (4, 2020, 1, 0)], "e int, p int, y int, c int")
    profiles = spark.createDataFrame([(e, 2020, 60, m) for e, m in ((1, 1.0), (2, 1.1), (3, 1.3), (4, 9.0))], "e int, p int, n int, m double")
    got = {r["e"]: (r["prior"], r["neighbours"]) for r in coldstart.lookup(log, profiles, "e", "p", "y", "c", ["m"], "n", "n", coldstart.ColdStart(neighbours=1)).collect()}
    assert got == {1: (0.0, 1), 2: (1.0, 1), 3: (1.0, 1), 4: (0.0, 1)}


def test_nearest_equals_all_pairs(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    points = [(p, e, float(x), float(round(y, 1)), None if e % 7 == 0 else float(e)) for p in (1, 2) for e, (x, y) in enumerate(rng.normal(size=(90, 2)) ** 3)]
    points += [(1, 1000, 5.0, None, 1.0), (3, 1, 0.0, 0.0, 1.0), (3, 2, 0.0, 0.0, 2.0)]
    got = {}
    for r in coldstart.nearest(spark.createDataFrame(points, "p int, e int, x double, y double, v double"), "e", "p", ["x", "y"], "v", 6, cell=20).collect():
        got.setdefault((r["p"], r["e"]), []).append((round(r["d"], 9), r["_other"]))
    want = {}
    for p, e, x, y, _ in points:
        near = sorted((round((((x - a) ** 2 + (y - b) ** 2) / 2) ** 0.5, 9), o) for q, o, a, b, v in points if q == p and o != e and v is not None and y is not None and b is not None)[:6]
        if near:
            want[p, e] = near
    assert {k: sorted(v) for k, v in got.items()} == want


def test_pairs_of_neighbours_grow_with_the_points(spark):
    """Not with their square, whatever the copies and ties; and every point's nearest are those of all pairs."""
    import numpy as np

    met = {}
    for n in (1_000, 4_000):
        rng = np.random.default_rng(n)
        xy = rng.normal(size=(n, 2))
        xy[: n // 4] = [0.5, 0.5]  # a quarter are copies of one point
        xy[n // 4 : n // 2, 0] = 0.0  # another quarter ties in the first metric
        df = spark.createDataFrame([(1, i, float(a), float(b), float(i)) for i, (a, b) in enumerate(xy)], "p int, e int, x double, y double, v double")
        met[n] = coldstart.near_pairs(df, "e", "p", ["x", "y"], "v", 5).count()
        if n == 1_000:
            got = {}
            for r in coldstart.nearest(df, "e", "p", ["x", "y"], "v", 5).collect():
                got.setdefault(r["e"], []).append((r["d"], r["_other"]))
            for i in range(0, n, 9):
                d = np.sqrt(((xy - xy[i]) ** 2).sum(1) / 2)
                d[i] = np.inf
                assert [o for _, o in sorted(got[i])] == np.lexsort((np.arange(n), d))[:5].tolist()
    assert met[4_000] < 6 * met[1_000] < 6 * 1_000 * 120


def test_neighbours_in_many_dimensions_and_small_groups(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    data = rng.normal(size=(400, 5))
    df = spark.createDataFrame([(i % 3 if i < 390 else 9 + i % 5, i, *map(float, x), float(i)) for i, x in enumerate(data)], "p int, e int, a double, b double, c double, d double, f double, v double")
    got = {}
    for r in coldstart.nearest(df, "e", "p", list("abcdf"), "v", 4, cell=12).collect():
        got.setdefault(r["e"], []).append((r["d"], r["_other"]))
    period = np.array([i % 3 if i < 390 else 9 + i % 5 for i in range(400)])
    for i in range(400):
        d = np.where((period == period[i]) & (np.arange(400) != i), np.sqrt(((data - data[i]) ** 2).sum(1) / 5).round(9), np.inf)
        want = [o for o in np.lexsort((np.arange(400), d))[:4].tolist() if d[o] < np.inf]
        assert [o for _, o in sorted((round(x, 9), o) for x, o in got.get(i, []))] == want


@pytest.mark.parametrize("held", [0, 10_000])
def test_quantiles_equal_percentiles(spark, held):
    import random

    from tidemark.operators.quantiles import quantiles

    r = random.Random(6)
    data = [(g, None if r.random() < 0.1 else round(r.gauss(0, 1), 2), r.choice([1, 1, 1, 2, None])) for g in ["a", "b", None] for _ in range(700)] + [("one", 3.5, None), ("none", None, None)]
    df = spark.createDataFrame(data, "g string, x double, k int")
    for by in (["g"], []):
        want = df.groupBy(*by).agg(*[F.percentile(c, F.array(F.lit(0.0), F.lit(0.25), F.lit(0.5), F.lit(0.9), F.lit(1.0))).alias(c) for c in ("x", "k")])
        got = quantiles(df, by, ["x", "k"], [0.0, 0.25, 0.5, 0.9, 1.0], held)
        key = lambda rows: sorted((repr(x[:-2]), [None if v is None else [round(y, 9) for y in v] for v in x[-2:]]) for x in map(tuple, rows))
        assert key(got.collect()) == key(want.select(*got.columns).collect())
    large = spark.range(60_000).select((C("id") * 7919 % 60_000 / F.lit(7.0)).alias("x"))
    assert list(quantiles(large, [], ["x"], [0.25, 0.5], held).first()["x"]) == pytest.approx([59_999 / 28, 59_999 / 14])
    plan = quantiles(df, ["g"], ["x"], [0.5], 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect" not in plan


def test_fingerprints_add_up(spark):
    """Equal sequences alone have equal fingerprints, whatever the partitions; no rows are collected."""
    data = [("a", 1, "x", 1), ("a", 2, "y", None), ("b", 11, "x", 1), ("b", 19, "y", None), ("c", 1, "y", None), ("c", 2, "x", 1), ("d", 1, "x", 1), ("e", 1, "x", 1), ("e", 2, "y", None), ("e", 3, "y", None), ("f", 1, "x|1", None), (None, 1, "x", 1), (None, 2, None, None)]
    df = spark.createDataFrame(data, "g string, o int, s string, m int")
    found = {r.g: r.f for r in resolve.fingerprints(df.repartition(5), ["g"], ["s", "m"], "o", "f").collect()}
    assert found["a"] == found["b"] and len(set(found.values())) == len(found) - 1
    assert found == {r.g: r.f for r in resolve.fingerprints(df.withColumn("at", F.when(C("g") == "b", (C("o") > 11).cast("int") + 1).otherwise(C("o"))), ["g"], ["s", "m"], "o", "f", place="at").collect()}
    assert "collect_list" not in resolve.fingerprints(df, ["g"], ["s", "m"], "o")._jdf.queryExecution().optimizedPlan().toString()


def test_sums_and_numbers_over_ranges(spark):
    import random

    r = random.Random(3)
    data = [(r.choice(["a", "b", None]), r.choice([None, *range(40)]), r.randint(0, 9), i) for i in range(400)]
    df = spark.createDataFrame(data, "g string, o int, v int, n int")
    for rows in (1000, 60):
        got = {(x["g"], x["o"]): (x["s"], x["s_here"]) for x in ranges.running(df.filter("o is not null"), ["g"], "o", {"s": C("v")}, rows).collect()}
        assert got == {(g, o): tuple(sum(w for h, p, w, _ in data if h == g and p is not None and f(p, o)) for f in (int.__lt__, int.__eq__)) for g, o, _, _ in data if o is not None}
        numbers = {x["n"]: (x["k"], x["t"]) for x in ranges.numbered(df, ["g"], ["o", "n"], "k", {"t": F.nullif(C("v"), F.lit(0))}, rows).collect()}
        latest = {x["n"]: x["l"] for x in ranges.last_before(df.withColumn("v", F.nullif(C("v"), F.lit(4))), ["g"], ["o", "n"], "v", "l", rows).collect()}
        for g in ("a", "b", None):
            own = sorted((x for x in data if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[3]))
            assert [(numbers[x[3]][0], numbers[x[3]][1] or 0) for x in own] == [(i + 1, sum(y[2] for y in own[: i + 1])) for i in range(len(own))]
            assert [latest[x[3]] for x in own] == [next((y[2] for y in reversed(own[:i]) if y[2] != 4), None) for i in range(len(own))]


def test_ranges_follow_the_rows_and_part_a_hot_group(spark):
    """A group with a third of all rows lies in many ranges, whose sizes stay the same when rows become tenfold."""
    for n in (6_000, 60_000):
        df = spark.range(n).select(F.when(C("id") % 3 == 0, "hot").otherwise(C("id").cast("string")).alias("g"), "id")
        at, parts = ranges.ranged(df, ["g"], ["id"], 1000)
        sizes = at.groupBy("_range").agg(F.count("*").alias("n"), F.count_if(C("g") == "hot").alias("hot")).collect()
        assert parts == n // 1000 and max(r.n for r in sizes) < 2500 and sum(r.hot > 0 for r in sizes) > parts // 5


def test_hot_key_results_do_not_depend_on_ranges(spark, monkeypatch):
    rows = [("hot" if i % 3 else f"k{i % 7}", i % 5, i, (i * 7) % 4 // 3) for i in range(900)]
    log = spark.createDataFrame(rows, "k string, p int, o int, y int")
    asked = spark.createDataFrame([(k, t) for k in ("hot", "k0", "k3", "none", None) for t in range(-1, 920, 13)], "k string, o int")

    def results():
        recent = history.recent_rates(log, "k", "p", "y", "o", 20)
        asof = history.asof_join(asked, log, "k", "o", ["y", "p"], "p")
        ranked = tables.percent_ranks(log.withColumn("o", F.nullif(C("o") % 11, F.lit(3))), "o", ["k"], "r")
        return [sorted(map(tuple, x.collect()), key=repr) for x in (recent, asof, ranked, evaluate.auc(log.withColumn("q", C("o") % 9 / 9.0), "y", "q", ["k"]))]

    whole = results()
    monkeypatch.setattr(ranges, "ROWS", 50)
    assert results() == whole


def test_sessions_over_many_ranges(spark):
    import random

    r = random.Random(4)
    data = [(p, i, r.choice(["x", "x", "x", "x", None]), r.choice([1, 2, 2, 3, None])) for p in (1, 2) for i in range(300)] + [(3, i, "x", 1) for i in range(60)]
    want, last, session, place = {}, None, 0, 0
    for p, n, c, f in data:
        new = last is None or last[0] != p
        session = 0 if new else session
        opens = new or c is None or last[2] is None or c != last[2] or (f is not None and last[3] is not None and f < last[3])
        session, place = (session + 1, 1) if opens else (session, place + 1)
        want[p, n], last = (session, place), (p, n, c, f)
    df = spark.createDataFrame(data, "p int, n int, c string, f int")
    for rows in (1000, 50):
        assert {(x["p"], x["n"]): (x["session"], x["place"]) for x in resolve.sessions(df, "p", "n", ["c"], ["f"], rows).collect()} == want


def test_no_task_takes_a_whole_period(spark, monkeypatch):
    """No window or sort is dealt out by the period alone; what is has a row per range."""
    monkeypatch.setattr(ranges, "ROWS", 100)
    df = spark.range(1000).selectExpr("id % 2 as p", "id as n", "cast(id % 3 as string) as c", "id % 5 as f", "id % 2 as y", "id / 1000.0D as q")
    for out in (resolve.sessions(df, "p", "n", ["c"], ["f"]), evaluate.auc(df, "y", "q", ["p"]), tables.percent_ranks(df, "q", ["p"], "k")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "_range" in plan


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "y int, p double")
    m = evaluate.metrics(df, "y", "p").first()
    assert m["brier"] < 0.25 and 0 <= evaluate.calibration_error(df, "y", "p").first()[0] <= 1
    assert evaluate.auc(df.withColumn("g", F.lit(1)), "y", "p", ["g"]).first()["auc"] == 1.0
    assert evaluate.auc(df.filter("y = 1").withColumn("g", F.lit(1)), "y", "p", ["g"]).first()["auc"] is None
    worse = df.withColumn("p", 1 - C("p"))
    assert evaluate.metrics(worse, "y", "p").first()["skill"] < 0 == evaluate.metrics(worse, "y", "p", clamp=True).first()["skill"]


def test_bin_edges_are_ieee_sums(spark):
    got = spark.createDataFrame([(0.3,), (0.1,), (0.30000000000000004,), (1.0,), (0.0,)], "p double").select(evaluate.bin_of(C("p"))).collect()
    assert [r[0] for r in got] == [2, 1, 3, 9, 0]


def test_deltas_and_comparisons(spark):
    board = spark.createDataFrame([("v1", None, 0.249), ("candidate", "v1", 0.247)], "name string, ref string, brier double")
    assert {r["name"]: r["delta"] for r in evaluate.paired_deltas(board, "name", "ref", "brier").collect()} == {"v1": None, "candidate": pytest.approx(-0.002)}
    a, b = (spark.createDataFrame([(2022, x), (2023, y)], "season int, brier double") for x, y in ((0.2, 0.3), (0.3, 0.5)))
    assert {r["season"]: r["brier"] for r in evaluate.compare_tables(a, b, "season", ["brier"]).collect()} == {"2022": pytest.approx(-0.1), "2023": pytest.approx(-0.2), "mean": pytest.approx(-0.15)}
    with pytest.raises(ValueError):
        evaluate.compare_tables(a, b.filter("season = 2022"), "season", ["brier"])


def test_leaderboard_takes_comparable_latest_runs(spark):
    history_rows = spark.createDataFrame([("a", "success", "s", "1", 0.3), ("a", "success", "s", "2", 0.2), ("b", "failed", "s", "3", None), ("c", "success", "t", "1", 0.1), ("d", "success", "s", "1", 0.1)], "experiment string, status string, data_signature string, finished_at string, brier double")
    assert [(r["experiment"], r["brier"]) for r in evaluate.leaderboard(history_rows, {"data_signature": "s"}).collect()] == [("d", 0.1), ("a", 0.2)]


def test_ridge_equals_the_closed_form(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, alpha = rng.normal(size=(60, 2)), 3.0
    y = x @ [0.5, -1.0] + 0.3 + rng.normal(size=60) * 0.1
    got = models.ridge(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, r double"), ["a", "b"], "r", alpha)
    xc, yc = x - x.mean(0), y - y.mean()
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(2), xc.T @ yc)
    assert got.coefficients == pytest.approx(want.tolist(), abs=1e-9) and got.intercept == pytest.approx(y.mean() - x.mean(0) @ want)


def test_residual_design_equals_plain_arrays(spark):
    import numpy as np

    train = [(1.0, None, "a", 0.2, 1), (None, None, "b", 0.5, 0), (4.0, None, None, 1.0, 1), (9.0, None, "a", 0.0, 0), (2.0, None, "a", 0.7, 1)]
    test = [(None, 3.0, "new", 0.3, 1), (1.0, None, "b", 0.3, 0)]
    schema = "x double, void double, c string, p double, y int"
    rows, other = spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)
    design = models.residual_design(rows, ["x", "void"], ["c"])
    assert design.names == ["x", "void", "c___MISSING__", "c_a", "c_b"]
    plain = lambda data: np.array([[3.0 if x is None else x, 0.0 if v is None else v, c is None, c == "a", c == "b"] for x, v, c, _, _ in data], float)
    mean, std = plain(train).mean(0), plain(train).std(0)
    std[std < 1e-6] = 1
    p = np.clip([r[3] for r in test], 1e-5, 1 - 1e-5)
    want = np.column_stack([(plain(test) - mean) / std, p, np.log(p / (1 - p))])
    got = np.array([list(r) for r in other.select(*[x.alias(n) for n, x in design.columns("p").items()]).collect()])
    assert got == pytest.approx(want)
    model = models.residual_model(rows, ["x"], ["c"], "p", "y", 2.0)
    design = model.design
    a = np.array([list(r) for r in rows.select(*[x.alias(n) for n, x in design.columns("p").items()]).collect()])
    r = np.array([y - q for *_, q, y in train])
    ac, rc = a - a.mean(0), r - r.mean()
    coef = np.linalg.solve(ac.T @ ac + 2.0 * np.eye(a.shape[1]), ac.T @ rc)
    b = np.array([list(x) for x in other.select(*[x.alias(n) for n, x in design.columns("p").items()]).collect()])
    assert [x[0] for x in other.select(model.correction("p")).collect()] == pytest.approx(((b - a.mean(0)) @ coef + r.mean()).tolist(), abs=1e-8)


def seasons(spark):
    return spark.createDataFrame([(f"r{i}", 2019 + i // 80, float(i % 20 - 10), "ab"[i % 2], int(i % 20 > 10) if i < 320 else None) for i in range(340)], "row_id string, period int, x double, c string, y int")


def test_splits_raise_for_an_empty_side(spark):
    rows = seasons(spark)
    at = validate.split(rows, "period", 2021, "y")
    assert (at.train_n, at.valid_n, at.train.count(), at.valid.count()) == (160, 80, 160, 80)
    for valid in (2019, 2023):
        with pytest.raises(ValueError):
            validate.split(rows, "period", valid, "y")


def test_tune_then_refit(spark):
    rows = seasons(spark)
    boosted = {"type": "boosted", "refit_after_tuning": True, "params": {"maxIter": 5, "seed": 1}}
    model, forecast, found = validate.tune_refit_evaluate(rows, boosted, ["x", "c"], ["c"], "period", 2021, "y")
    assert 1 <= model.rounds <= 5 and found["brier"] < 0.1 and found["tuning_period"] == 2020 and (found["tuning_train_n"], found["train_n"], found["valid_n"]) == (80, 160, 80)
    assert forecast.filter("p between 0 and 1").count() == 80 and "c_freq" not in forecast.columns
    forecasts, folds = validate.forward_folds(rows, {"type": "boosted", "params": {"maxIter": 3, "seed": 1}}, ["x", "c"], ["c"], "period", [2018, 2020, 2021], "y")
    assert sorted(r["period"] for r in folds.collect()) == [2020, 2021] and forecasts.count() == 160
    assert validate.final_fit(rows, {"type": "boosted", "params": {"maxIter": 3, "seed": 1}}, ["x"], [], "y", folds, least=4).rounds == 4
    with pytest.raises(ValueError):
        validate.forward_folds(rows, {"type": "constant"}, [], [], "period", [1990], "y")
    out = validate.submission(rows.withColumn("p", F.lit(1.0)), "row_id")
    assert out.columns == ["row_id", "p"] and out.first()["p"] == 1 - 1e-5


@pytest.mark.parametrize("kind", ["boosted", "forest", "logistic", "ridge", "extra_trees"])
def test_a_feature_may_have_the_forecasts_name(spark, kind):
    """The same forecasts as with the feature under another name, in its column's place."""
    config = {"type": kind, "params": {"boosted": {"maxIter": 3, "seed": 1}, "forest": {"numTrees": 3, "seed": 1}, "extra_trees": {"trees": 3, "seed": 1}}.get(kind, {})}
    run = lambda f: validate.tune_refit_evaluate(seasons(spark).withColumnRenamed("x", f), config, [f, "c"], ["c"], "period", 2021, "y")
    (_, got, found), (_, want, expected) = run("p"), run("q")
    assert sorted(got.columns) == ["c", "p", "period", "row_id", "y"] and found["brier"] == pytest.approx(expected["brier"], abs=1e-9)
    assert rows(got.select("row_id", F.round("p", 9)), "row_id") == rows(want.select("row_id", F.round("p", 9)), "row_id")


def test_boosted_query_forecasts_every_row_of_the_last_period(spark, sf_dir):
    from __spark_entry__ import queries
    from tidemark.sources.views import log

    got = queries()["M02_boosted"](spark, sf_dir)
    assert got.count() == log(spark, sf_dir).filter("period = 2000").count() and got.filter("forecast between 0 and 1").count() == got.count()


@pytest.mark.parametrize("kind", ["leaf_wise", "second_order", "ordered"])
def test_boosted_learners_tune_and_fold(spark, kind):
    rows = seasons(spark).withColumn("x", F.when(C("x") < 0.9, C("x")))
    config = {"type": kind, "refit_after_tuning": True, "params": {"rounds": 6, "rate": 0.5, "depth": 3, "bins": 16, "least_weight": 0.1, "least_rows": 2, "rows_share": 1.0, "features_share": 1.0, "early_stopping_rounds": 3}}
    model, forecast, found = validate.tune_refit_evaluate(rows, config, ["x", "c"], ["c"], "period", 2021, "y")
    assert 1 <= model.rounds <= 6 and found["brier"] < 0.15 and forecast.columns == [*rows.columns, "p"]
    forecasts, folds = validate.forward_folds(rows, config, ["x", "c"], ["c"], "period", [2020, 2021], "y")
    got = {r["period"]: r for r in folds.collect()}
    assert forecasts.count() == 160 and got[2021]["train_n"] == 160 and all(1 <= r["best_iteration"] <= 6 for r in got.values())
    alone = validate.forward_folds(rows, config, ["x", "c"], ["c"], "period", [2021], "y")[1].first()
    assert alone["brier"] == pytest.approx(got[2021]["brier"], abs=1e-9)
    unseen = model.predict(spark.createDataFrame([(None, "never"), (0.2, None)], "x double, c string")).collect()
    assert all(0 < r["p"] < 1 for r in unseen)
    with pytest.raises(ValueError):
        models.fit_configured({"type": kind, "params": {"what": 1}}, rows, ["x"], [], "y")


def test_trees_are_saved_as_plain_values(spark, tmp_path):
    rows = seasons(spark)
    model = models.fit_configured({"type": "leaf_wise", "params": {"rounds": 3, "least_rows": 2}}, rows, ["x", "c"], ["c"], "y")
    files.save_model(spark, model.model, str(tmp_path / "m"))
    again = trees.Boosted.unbundle(files.read_json(spark, str(tmp_path / "m" / "bundle")))
    p = [{r["row_id"]: r["p"] for r in x.predict(rows).collect()} for x in (model, again)]
    assert p[0] == pytest.approx(p[1])


def test_extra_trees_take_missing_numbers_and_categories(spark):
    rows = seasons(spark).withColumn("x", F.when(C("x") < 0.9, C("x")))
    model = models.fit_configured({"type": "extra_trees", "params": {"trees": 5, "depth": 4, "least_rows": 2, "seed": 1}}, rows, ["x", "c"], ["c"], "y")
    assert model.predict(rows).agg(F.avg((C("p") - C("y")) ** 2)).first()[0] < 0.2 and model.rounds == 5


def test_forward_ridge_reads_the_log_once(spark):
    rows = seasons(spark)
    forecasts, folds = validate.forward_folds(rows, {"type": "ridge", "params": {"alpha": 2.0}}, ["x"], [], "period", [2020, 2021], "y")
    train = rows.filter("period < 2021 and y is not null").select("x", "y").toPandas()
    x, y = train["x"] - train["x"].mean(), train["y"]
    slope = float((x * y).sum() / ((x * x).sum() + 2.0))
    want = {r["row_id"]: min(max(float(y.mean()) + slope * (r["x"] - float(train["x"].mean())), 0.0), 1.0) for r in rows.filter("period = 2021 and y is not null").collect()}
    assert {r["row_id"]: r["p"] for r in forecasts.filter("period = 2021").collect()} == pytest.approx(want) and folds.count() == 2


def test_staged_brier_is_that_of_shorter_models(spark):
    df = spark.createDataFrame([(float(i % 20 - 10), int(i % 20 > 10 or i % 7 == 0)) for i in range(200)], "x double, y int")
    whole = models.staged_brier(models.fit(df, ["x"], "y", "boosted", maxIter=4, seed=3), df, "y")
    for k in (1, 2, 4):
        p = models.predict(models.fit(df, ["x"], "y", "boosted", maxIter=k, seed=3), df)
        assert whole[k - 1] == pytest.approx(p.agg(F.avg((C("p") - C("y")) ** 2)).first()[0], abs=1e-6)


def test_models_take_missing_features(spark):
    df = spark.createDataFrame([(float(i % 20 - 10) if i % 3 else None, None, int(i % 20 > 10)) for i in range(120)], "x double, void double, y int")
    model = models.fit(df, ["x", "void"], "y", "forest", numTrees=3, seed=1)
    assert models.predict(model, df).filter("p is null").isEmpty()
    assert [f for f, _ in models.importances(model, ["x", "void"])] == ["x", "void"]


CONFIG = {
    "feature_sets": {"plain": {}, "broken": {"blocks": ["nothing"]}},
    "models": {"rate": {"type": "constant"}, "line": {"type": "logistic", "family": "linear"}},
    "baseline_experiment": "a",
    "experiments": [
        {"name": "a", "feature_set": "plain", "model": "rate", "presets": ["starter", "extended"]}, {"name": "b", "feature_set": "plain", "model": "line", "comparison_experiment": "a", "presets": ["extended"]},
        {"name": "c", "feature_set": "broken", "model": "rate", "presets": ["extended"]}, {"name": "off", "feature_set": "plain", "model": "rate", "enabled": False},
    ],
}


def test_presets_and_unknown_names(spark):
    names = lambda *a: [e["name"] for e in lab.select_experiments(spark, CONFIG, *a)]
    assert (names("starter"), names("extended"), names("all"), names("starter", ["b", "a"])) == (["a"], ["a", "b", "c"], ["a", "b", "c"], ["b", "a"])
    for bad in (lambda: names("starter", ["unknown"]), lambda: names("none"), lambda: lab.load_config("{}")):
        with pytest.raises(ValueError):
            bad()


def test_experiments_are_selected_as_by_sql(spark, sf_dir, tmp_path):
    """With containers: what the SQL gives. On the driver's parts, which have none: by brand alone."""
    duckdb = pytest.importorskip("duckdb")
    from __spark_entry__ import oracle_sql, queries

    path, of = f"{tmp_path}/part.parquet", lambda d: sorted(rows(queries()["F09_select"](spark, str(d)).select("preset", "turn", "name")), key=str)
    given = [(1, "a", "Brand#11", "x", 1), (2, None, "Brand#12", "Brand#11", 2), (3, "c", None, "Brand#11", 3), (4, "d", "Brand#11", None, None), (5, "e", "Brand#11", "x", 5), (6, "f", None, None, 6), (7, "g", "Brand#2", "y", -7)]
    spark.createDataFrame(given, "p_partkey long, p_name string, p_brand string, p_container string, p_size int").write.parquet(path)
    want = duckdb.sql(oracle_sql()["F09_select"].replace("FROM part)", f"FROM '{path}/*.parquet')")).fetchall()
    assert of(tmp_path) == sorted(want, key=str) and ("Brand#11", 2, None) in want

    parts = [r for r in spark.read.parquet(f"{sf_dir}/part.parquet").collect() if r.p_size % 5]
    kept = [(p, r.p_partkey, f"{r.p_name}/{r.p_partkey}") for r in parts for p in ("all", "Brand#11") if p in ("all", r.p_brand)]
    assert of(sf_dir) == sorted(kept, key=str) and {p for p, *_ in kept} == {"all", "Brand#11"}


def test_matrix_skips_what_is_done_and_records_failures(spark, tmp_path):
    rows, folder = seasons(spark), str(tmp_path)
    views = {"v1": lab.View(rows, ["x", "c"], ["c"])}
    run = lambda **k: lab.run_matrix(spark, CONFIG, views, folder, 2021, preset="extended", data_signature="d", **k)
    board = [(r["experiment"], r["brier_delta_vs_baseline"]) for r in run(save_models=True).collect()]
    assert [b[0] for b in board] == ["b", "a"] and board[0][1] < 0 == board[1][1]
    history = lab.history_of(spark, folder)
    assert sorted(r["status"] for r in history.collect()) == ["failed", "success", "success"] and history.filter("error like '%nothing%'").count() == 1
    assert run().count() == 2 and lab.history_of(spark, folder).count() == 4  # the failed one alone ran again
    assert run(rerun=True).count() == 2 and lab.history_of(spark, folder).count() == 7
    text = files.read_text(spark, f"{folder}/report")
    assert "2 experiments finished" in text and "1 | b | " in text and "Measured against a" in text and "Changes" in text
    assert lab.already_completed(history, "d", history.filter("experiment = 'a'").first()["config_hash"], "full") and not lab.already_completed(history, "e", "x", "full")
    with pytest.raises(ValueError):
        lab.check_views({"v1": views["v1"], "v2": lab.View(rows.filter("x > 0"), ["x"])}, "row_id", "period", 2021, "y")


def test_report_tables(spark):
    board = spark.createDataFrame([("v1", None, 0.2500, "boosted", "s1", 3.0), ("threat", "v1", 0.2475, "boosted", "s2", 5.0), ("other", "gone", 0.3, "x", "s2", None)], "experiment string, preprocessing_comparison_experiment string, brier double, model_family string, preprocessing_stage string, elapsed_seconds double")
    got = {r["experiment"]: (r["brier_delta_vs_preprocessing"], r["brier_delta_vs_comparison"], r["brier_delta_vs_baseline"]) for r in report.with_deltas(board, "v1").collect()}
    assert got == {"v1": (None, None, 0.0), "threat": (pytest.approx(-0.0025), None, pytest.approx(-0.0025)), "other": (None, None, pytest.approx(0.05))}
    assert [r["experiment"] for r in report.stage_comparison(board, ["boosted"]).collect()] == ["v1", "threat"] and report.final_stage(board, ["boosted"], "s2").first()["experiment"] == "threat"
    assert [r["experiment"] for r in report.score_against_time(board).collect()] == ["v1", "threat"]
    assert report.baseline_deltas(board, "none").filter("brier_delta_vs_baseline is not null").isEmpty()
    text = report.markdown(report.with_deltas(board, "v1"), "v1", 2024)
    assert "3 experiments finished" in text and "0.247500 (threat)" in text and "1.000 % lower" in text and "| -0.002500" in text and "s2 | 2 | threat | 0.247500 | 0.052500" in text
    assert "a\\|b" in report.markdown(board.withColumn("experiment", F.lit("a|b")), "x", 2024) and "No experiment" in report.markdown(board.limit(0), "x", 2024)
    assert "Ranking" in report.markdown(board.select("experiment", "brier"), "x", 2024)


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("t0", 2020, 1, True, 1.0, "a"), ("t1", 2020, 0, True, None, "__MISSING__"), ("s0", 2021, None, False, 3.0, "b")], "row_id string, period int, y int, is_train boolean, number double, kind string")
    bundle = export.Bundle(rows, ["number", "kind"], ["kind"])
    assert export.export_matrix(bundle, True).columns == ["row_id", "y", "number", "kind"] and export.export_matrix(bundle, False).columns == ["row_id", "number", "kind"]
    schema = export.feature_schema(bundle).orderBy("position").collect()
    assert [(r["feature"], r["is_categorical"], r["train_missing_n"], r["train_missing_rate"], r["test_missing_n"], r["test_missing_rate"]) for r in schema] == [("number", False, 1, 0.5, 0, 0.0), ("kind", True, 1, 0.5, 0, 0.0)]
    folder = str(tmp_path / "out")
    summary = export.export(bundle, folder, 1, {"smoothing": 50})
    assert (summary["train_rows"], summary["test_rows"], files.read_json(spark, f"{folder}/preprocessing_summary")["smoothing"]) == (2, 1, 50)
    assert spark.read.parquet(f"{folder}/train_features").count() == 2 and spark.read.csv(f"{folder}/train_features_preview", header=True).count() == 1
    with pytest.raises(ValueError):
        export.export_matrix(export.Bundle(rows.withColumn("y", F.lit(None).cast("int")), ["number"], []), True)


def test_raw_view(spark):
    columns = [*blocks.RAW_NUMERIC, *blocks.RAW_CATEGORICAL]
    assert (len(set(columns)), len(blocks.RAW_CATEGORICAL)) == (47, 9)
    df = spark.createDataFrame([tuple([float("inf")] + [1.0] * 37 + ["12.0"] * 8 + [None])], ", ".join(f"{c} {'double' if c in blocks.RAW_NUMERIC else 'string'}" for c in columns))
    row = blocks.raw_view(df).first()
    assert (row[columns[0]], row["pitcher_id"], row["batter_hand"], len(row)) == (None, "12", "__MISSING__", 47)
    with pytest.raises(ValueError):
        blocks.raw_view(df.drop("li"))


def test_joins_with_other_names_and_seeds(spark):
    a, b = spark.createDataFrame([(1, 2, "x"), (1, 3, "y")], "g int, n int, v string"), spark.createDataFrame([(1, 3, "z"), (1, 3, "w")], "h int, m int, v2 string")
    with pytest.raises(ValueError):
        tables.matched(a, b, {"g": "h", "n": "m"})
    assert sorted(rows(tables.matched(a, b, {"g": "h", "n": "m"}, unique=False))) == [(1, 3, "y", "w"), (1, 3, "y", "z")]
    left, right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, l string"), spark.createDataFrame([(1, "e"), (2, "f"), (None, "g")], "k int, r string")
    assert rows(resolve.seed_join(left, right, ["k"])) == [(2, "c", "f")]


def test_empty_and_missing_states_have_other_fingerprints(spark):
    df = spark.createDataFrame([(1, "", 1), (2, None, 1)], "g int, s string, o int")
    assert resolve.fingerprints(df, ["g"], ["s"], "o", "f").select("f").distinct().count() == 2


def test_learners(spark):
    df = spark.createDataFrame([(float(i % 20 - 10), int(i % 20 > 10)) for i in range(120)], "x double, y int")
    for kind, params in (("logistic", {}), ("boosted", {"maxIter": 5, "seed": 1}), ("forest", {"numTrees": 5, "seed": 1})):
        p = models.predict(models.fit(df, ["x"], "y", kind, **params), df)
        assert evaluate.metrics(p, "y", "p").first()["brier"] < 0.1
    assert models.constant_rate(df, "y") == pytest.approx(0.45)
    assert 1 <= models.tuned_rounds(df, df, ["x"], "y", 4) <= 4


def test_sample_is_stable_and_bounded(spark):
    df = spark.range(1000).withColumn("g", C("id") % 3)
    a, b = (sorted(rows(tables.sample_per_group(x, "g", "id", 10, 7))) for x in (df, df.repartition(7)))
    assert a == b and len(a) == 30


def test_files(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_bytes("﻿id,등급\n1,확정\n,확정\n3,x\n".encode())
    got = files.read_mapping(spark, str(csv), "id string, grade string", "id", "grade", ["확정"])
    assert [r["accepted"] for r in got.collect()] == [True, False, False]
    calls = []
    make = lambda: calls.append(1) or spark.range(3)
    for _ in range(2):
        assert files.cached(spark, str(tmp_path / "cache"), {"a": 1, "b": 2}, make).count() == 3
    assert len(calls) == 1 and files.signature({"a": 1, "b": 2}) == files.signature({"b": 2, "a": 1})
    files.cached(spark, str(tmp_path / "cache"), {"a": 1, "b": 2}, make, str(csv))
    files.cached(spark, str(tmp_path / "cache"), {"a": 1, "b": 2}, make, str(csv))
    csv.write_bytes(csv.read_bytes() + b"4,y\n")
    files.cached(spark, str(tmp_path / "cache"), {"a": 1, "b": 2}, make, str(csv))
    assert len(calls) == 3

    def broken():
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        files.cached(spark, str(tmp_path / "cache"), "broken", broken)
    half = tmp_path / "cache" / files.signature(["half", []])
    spark.range(9).write.parquet(str(half / "0123"))  # a write that broke off before its marker
    assert files.cached(spark, str(tmp_path / "cache"), "half", make).count() == 3
    # A call that publishes while another one writes: both give the first one's table, and the other's is gone.
    inner = lambda: files.cached(spark, str(tmp_path / "cache"), "race", lambda: spark.range(5)) and spark.range(7)
    assert files.cached(spark, str(tmp_path / "cache"), "race", inner).count() == 5
    assert len([x for x in (tmp_path / "cache" / files.signature(["race", []])).iterdir() if x.is_dir()]) == 2
    files.append_history(spark.createDataFrame([(1,)], "a int"), str(tmp_path / "h"))
    files.append_history(spark.createDataFrame([(2, "x")], "a int, b string"), str(tmp_path / "h"))
    assert sorted(rows(files.read_history(spark, str(tmp_path / "h")))) == [(1, None), (2, "x")]
    files.write_features(spark.range(5), str(tmp_path / "f"))
    files.write_features(spark.range(400_000).withColumn("r", F.rand(1)).repartition(1), str(tmp_path / "g"), 1 << 20)
    import pyarrow.parquet as pq

    (file,) = (tmp_path / "g").glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_row_groups > 1 and meta.row_group(0).column(0).compression == "ZSTD"
    files.write_json(spark, {"b": [1, "ü"]}, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j")) == {"b": [1, "ü"]}
    assert [tuple(r) for r in files.first_rows(spark.range(9), "id", 2).collect()] == [(0,), (1,)]
    plan = files.read_csv(spark, str(csv), "id string, grade string", ["grade"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<grade:string>" in plan
    files.write_csv(spark.range(5), str(tmp_path / "c"), 2, "id")
    assert spark.read.parquet(str(tmp_path / "f")).count() == 5 and spark.read.csv(str(tmp_path / "c"), header=True).count() == 2


def test_every_oracle_has_its_query():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
