"""Row-wise feature blocks and feature sets over them.

A block is a function from a frame's column names to new columns. A feature set is an ordered list of blocks and of name patterns to
drop; adding a column twice or naming an unknown block is an error. All blocks of a set become one projection.
"""

from __future__ import annotations

from collections.abc import Callable
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import MISSING, clip, finalize, flag, identifier, probability, require, share

Columns = dict[str, Column]
C = F.col


def count_state(balls: str = "balls", strikes: str = "strikes") -> Column:
    return F.concat(C(balls).cast("bigint").cast("string"), F.lit("-"), C(strikes).cast("bigint").cast("string"))


def count_flags() -> Columns:
    b, s = C("balls"), C("strikes")
    return {"pitcher_ahead": flag(s > b), "batter_ahead": flag(b > s), "two_strike": flag(s == 2), "three_ball": flag(b == 3), "full_count": flag((b == 3) & (s == 2))}


def runner_flags() -> Columns:
    n = C("runners")
    return {"has_runner": flag(n > 0), "risp": flag((C("on_2b") == 1) | (C("on_3b") == 1)), "bases_loaded": flag(n == 3)}


def score_flags() -> Columns:
    d = C("score_diff")
    return {"is_tie": flag(d == 0), "score_diff_abs": F.abs(d), "close_game": flag(F.abs(d) <= 2)}


def stage_flags(rule_period: int = 2024) -> Columns:
    return {"late_inning": flag(C("inning") >= 7), "extra_inning": flag(C("inning") >= 10), "rule_era": flag(C("period") >= rule_period)}


def stage_phase() -> Column:
    """A missing stage falls through to the last class."""
    i = C("inning")
    return F.when(i <= 3, "early").when(i <= 6, "middle").when(i <= 9, "late").otherwise("extra")


def matchup() -> Column:
    a, b = C("pitcher_hand"), C("batter_hand")
    return F.when(a.isNull() | b.isNull(), "missing").when(a == b, "same").otherwise("opposite")


def counters(names=("pitcher_n", "batter_n", "mix_n")) -> Columns:
    logs = {f"{n}_log1p": F.log1p(clip(C(n).cast("double"), 0.0)) for n in names}
    return logs | {f"{n}_missing": C(n).isNull().cast("int") for n in names}


SPANS = (1, 3, 5)


def trends() -> Columns:
    """Contrasts of recent and long-run rates, and how many recent values each rests on; 11 differences and 2 counts."""
    out: Columns = {}
    for kind in ("success", "middle"):
        recent = {n: C(f"prev{n}_{kind}") for n in SPANS}
        out |= {f"{kind}_trend_{a}v{b}": recent[a] - recent[b] for a, b in ((1, 3), (1, 5), (3, 5))}
        out[f"{kind}_prev1_gap"] = recent[1] - C(f"pitcher_{kind}")
    out |= {"success_batter_gap": C("pitcher_success") - C("batter_success"), "middle_batter_gap": C("pitcher_middle") - C("batter_middle"), "strike_ball_gap": C("pitcher_strike") - C("pitcher_ball")}
    for kind in ("success", "middle"):
        out[f"{kind}_trend_sources"] = sum((C(f"prev{n}_{kind}").isNotNull().cast("int") for n in SPANS[1:]), C(f"prev1_{kind}").isNotNull().cast("int"))
    return out


def situation() -> Columns:
    li, outs, zero = C("li"), C("outs"), lambda c: F.coalesce(C(c), F.lit(0))
    log_li, late, close = F.log1p(clip(li, 0.0)), zero("late_inning"), zero("close_game")
    state = F.concat(C("base_state"), F.lit("|o"), outs.cast("bigint").cast("string"))
    return {
        "li_log1p": log_li, "high_leverage": flag(li >= 2), "close_late": (late * close).cast("int"), "late_close_high_li": flag((late == 1) & (close == 1) & (li >= 2)),
        "pressure_score": log_li * (1 + late) * (1 + close), "risp_two_out": flag((C("risp") == 1) & (outs == 2)), "bases_loaded_less_two_out": flag((C("bases_loaded") == 1) & (outs < 2)),
        "runner_out_pressure": C("runners") * clip(3.0 - outs, 0.0) / 3.0, "count_pressure": zero("full_count") * log_li,
        "base_out_state": F.coalesce(state, F.lit(MISSING)), "count_base_out_state": F.coalesce(F.concat(C("count_state"), F.lit("|"), state), F.lit(MISSING)),
    }


def mix() -> Columns:
    """Entropy, extremes and gaps of three rates that may be missing one by one."""
    rates = [clip(C(n), 0.0, 1.0) for n in ("fastball", "breaking", "offspeed")]
    zero = [F.coalesce(r, F.lit(0.0)) for r in rates]
    seen = rates[0].isNotNull() | rates[1].isNotNull() | rates[2].isNotNull()
    total = F.when(seen, zero[0] + zero[1] + zero[2])
    part = lambda r: F.coalesce(r / total * F.ln(F.greatest(r / total, F.lit(1e-8))), F.lit(0.0))
    return {
        "mix_entropy": F.when(total > 0, -(part(rates[0]) + part(rates[1]) + part(rates[2]))), "mix_dominant": F.greatest(*rates), "mix_balance": F.least(*rates),
        "mix_fastball_breaking": rates[0] - rates[1], "mix_fastball_offspeed": rates[0] - rates[2], "mix_breaking_offspeed": rates[1] - rates[2],
        "mix_sum": total, "mix_available": flag(C("mix_n") > 0),
    }


def reliability(sensor: bool = True) -> Columns:
    """`sensor`: whether the frame has sensor_n; without it its share is zero."""
    p, b, m, h = share(C("pitcher_n"), 50), share(C("batter_n"), 50), share(C("mix_n"), 50), share(C("career_n"), 100)
    s = share(C("sensor_n"), 100) if sensor else F.lit(0.0)
    sources = flag(p > 0) + flag(b > 0) + flag(m > 0) + flag(F.coalesce(C("history_missing"), F.lit(1)) == 0) + flag(s > 0)
    return {"pitcher_share": p, "batter_share": b, "mix_share": m, "history_share": h, "sensor_share": s, "weighted_gap": p * C("pitcher_success") - b * C("batter_success"), "information_sources": sources}


def known_hand(c: Column) -> Column:
    """NULL for the missing literal too."""
    return F.when(c != MISSING, c)


def threat() -> Columns:
    """Products of probabilities; values outside [0, 1] count as missing, and so does a missing hand."""
    a, b = known_hand(C("pitcher_hand")), known_hand(C("batter_hand"))
    known = a.isNotNull() & b.isNotNull()
    success, other, reverse, middle, ball = (probability(C(n)) for n in ("pitcher_success", "batter_success", "pitcher_reverse", "pitcher_middle", "pitcher_ball"))
    return {
        "hand_match": F.when(known, (a == b).cast("double")), "success_interact": success * other, "reverse_x_middle": reverse * middle,
        "threat_x_reverse": (1 - other) * reverse, "threat_x_middle": (1 - other) * middle, "threat_x_ball": (1 - other) * ball,
    }


BLOCKS: dict[str, Callable[[], Columns]] = {"trends": trends, "situation": situation, "mix": mix, "reliability": reliability, "threat": threat}
#: Columns that each block reads.
NEEDS = {
    "trends": [*(f"prev{n}_{k}" for n in SPANS for k in ("success", "middle")), "pitcher_success", "pitcher_middle", "batter_success", "batter_middle", "pitcher_strike", "pitcher_ball"],
    "situation": ["li", "late_inning", "close_game", "risp", "outs", "bases_loaded", "runners", "full_count", "base_state", "count_state"],
    "mix": ["fastball", "breaking", "offspeed", "mix_n"],
    "reliability": ["pitcher_n", "batter_n", "mix_n", "career_n", "history_missing", "pitcher_success", "batter_success"],
    "threat": ["pitcher_hand", "batter_hand", "pitcher_success", "pitcher_reverse", "pitcher_middle", "pitcher_ball", "batter_success"],
}
CATEGORICAL = {"situation": ["base_out_state", "count_base_out_state"]}


def apply_feature_set(df: DataFrame, blocks: list[str], drop: list[str] = (), categorical: list[str] = ()) -> tuple[DataFrame, list[str], dict]:
    """(frame with the blocks added and matching columns dropped, names of its categoricals, report of what changed)."""
    if unknown := [b for b in blocks if b not in BLOCKS]:
        raise ValueError(f"unknown blocks {unknown}")
    added: Columns = {}
    for b in blocks:
        require(df, NEEDS[b], b)
        new = reliability("sensor_n" in df.columns) if b == "reliability" else BLOCKS[b]()
        if twice := (set(new) & (set(df.columns) | set(added))):
            raise ValueError(f"{b} adds columns that are there already: {sorted(twice)}")
        added |= new
    names = [*df.columns, *added]
    if idle := [p for p in drop if not any(fnmatch(n, p) for n in names)]:
        raise ValueError(f"patterns without a column {idle}")
    gone = [n for n in names if any(fnmatch(n, p) for p in drop)]
    kinds = [n for n in [*categorical, *(c for b in blocks for c in CATEGORICAL.get(b, []))] if n not in gone]
    return df.withColumns(added).drop(*gone), kinds, {"added": list(added), "dropped": gone, "columns": len(names) - len(gone)}


#: The columns of a raw log that go into a model as they are.
RAW_NUMERIC = [
    "season", "game_month", "game_dayofweek", "inning", "balls_before", "strikes_before", "outs_before", "run_top_before", "run_bot_before", "run_total_before", "score_diff_home", "score_diff_pitcher_team",
    "runner_on_1b", "runner_on_2b", "runner_on_3b", "num_runners_on", "home_win_expectancy", "away_win_expectancy", "li", "asof_pitcher_n", "asof_batter_n", "asof_pitcher_pitchmix_n",
    *(f"asof_pitcher_{k}_rate" for k in ("success", "reverse", "middle", "ball", "strike")), *(f"asof_pitcher_prev{n}_game_{k}_rate" for n in SPANS for k in ("success", "middle")),
    "asof_batter_success_rate", "asof_batter_middle_rate", *(f"asof_pitcher_{k}_rate" for k in ("fastball", "breaking", "offspeed")),
]
RAW_CATEGORICAL = ["top_bottom", "game_type", "base_state", "pitcher_id", "batter_id", "pitcher_team_id", "batter_team_id", "pitcher_hand", "batter_hand"]


def raw_view(rows: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The 47 raw columns, finished for a model, and nothing engineered; `keep` passes through."""
    require(rows, [*RAW_NUMERIC, *RAW_CATEGORICAL], "raw view")
    ids = {c: identifier(C(c)) for c in RAW_CATEGORICAL if c.endswith("_id")}
    return finalize(rows.select(*keep, *RAW_NUMERIC, *RAW_CATEGORICAL).withColumns(ids), RAW_CATEGORICAL, keep)


def feature_catalog(spark) -> DataFrame:
    """(block, feature) of every block."""
    return spark.createDataFrame([(b, n) for b, make in BLOCKS.items() for n in make()], "block string, feature string")
