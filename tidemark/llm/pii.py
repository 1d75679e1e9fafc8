"""Personal data by gradient-boosted candidates, in DataFrame expressions alone.

High-recall generators mark candidate spans: the base formats (email, ip, card, phone), whose valid matches are always redacted,
and further spellings (an address with [at] and [dot], a phone number without its country code, a full IPv6 address). A candidate
has a few small features of format and context. Trees are boosted on the histogram of these features over the candidates of three of
four documents; it has at most CELLS rows whatever the corpus. The labels are the formats' own checks (Luhn, ranges, digit counts,
the digits that area and exchange codes may have), and what these checks read is no feature of the trees: numbers of a phone's shape
that no phone can have show in which contexts the shape means something else. On the fourth document of four, which trained nothing,
the lowest score at which a kind's further spellings reach the wanted precision becomes its threshold; spellings that fail their own
check are never selected.

Positions count code points, end exclusive. Defined results: a null text counts as empty and has no span; U+0001 in a text is an
ordinary character; very long texts are read whole, their matches a chunk at a time; where spans of two kinds overlap both are reported,
and redaction joins them; an added span that overlaps a base span is left out; equal rows get equal spans; a text without candidates, and
an empty table, train nothing, and then no span is added; a null doc_id trains; further columns of any name pass through `redact`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<start:int,kind:int,end:int,form:int,valid:int,digits:int,separators:int,cue:int,alone:int,uniform:int>>"
#: Name of each feature and its number of values.
FEATURES = (("kind", 4), ("form", 2), ("valid", 2), ("digits", 6), ("separators", 4), ("cue", 2), ("alone", 2), ("uniform", 2))
CELLS = math.prod(n for _, n in FEATURES)
#: What the trees may split on: not the check that gives the labels.
SPLITS = tuple(f for f in FEATURES if f[0] != "valid")
#: Parts of a text that one aggregate goes through; even, so that a chunk starts between matches.
CHUNK = 256
#: One doc_id in so many calibrates and doesn't train.
FOLDS = 4
#: Words that announce personal data.
CUES = r"(?i)(?:mail|e-mail|phone|tel|call|fax|mobile|card|visa|account|address|contact|ip|host|reach)[^\n]{0,12}$"

LOCAL, LABEL = r"[A-Za-z0-9._%+\-]", r"[A-Za-z0-9\-]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: (kind, form, text that any match contains, Java pattern). A pattern starts where a run of its characters starts or where the last match ended, which is
#: where the leftmost match starts, so that a long run is read once.
GENERATORS = (
    (0, 0, "@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++"),
    (1, 0, ".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    (2, 0, "", r"(?<![0-9])(?<![0-9][ \-])[0-9](?:[ \-]?[0-9]){8,}+"),
    (3, 0, "+", r"\+[0-9][ ().0-9\-]+[0-9]"),
    (0, 1, "at", rf"(?i)(?<!{LOCAL}){LOCAL}{{1,64}}+ ?[\[(]at[\])] ?{LABEL}{{1,63}}+(?: ?(?:[\[(]dot[\])]|\.) ?[a-z]{{2,24}}+(?![A-Za-z0-9])){{1,4}}"),
    (1, 1, ":", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    (3, 1, "", r"(?<![0-9+(.\-])(?<![0-9] )(?:\([0-9]{3}\) ?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}(?![0-9.\-]|\s[0-9])"),
)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: int, form: int, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    if form == 1:
        return digits.rlike(r"^(?:[2-9](?!11)[0-9]{2}){2}") if kind == 3 else F.lit(True)
    return (F.lit(True), match.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"), n.between(12, 19) & luhn(digits), n.between(9, 15))[kind]


def _spans(text: Column, kind: int, form: int, gate: str, pattern: str) -> Column:
    """The candidates of one generator: matches are set between U+0001 marks, the text is split there, and lengths add up. The parts
    are taken CHUNK at a time, as each step of an aggregate copies what it has gathered."""
    marked = F.split(F.regexp_replace(text, pattern, "\x01$0\x01"), "\x01", -1)

    def candidate(state: Column, part: Column, before: Column) -> Column:
        digits = _digits(part)
        n, d = F.length(part), F.length(digits)
        return F.struct(
            state["at"].alias("start"), F.lit(kind).alias("kind"), (state["at"] + n).alias("end"), F.lit(form).alias("form"), _valid(kind, form, part).cast("int").alias("valid"),
            F.when(d == 0, 0).when(d < 9, 1).when(d < 12, 2).when(d < 16, 3).when(d < 20, 4).otherwise(5).alias("digits"),
            F.least(F.length(F.regexp_replace(part, r"[^ .()\-]", "")), F.lit(3)).alias("separators"), F.coalesce(F.right(before, F.lit(32)).rlike(CUES), F.lit(False)).cast("int").alias("cue"),
            (~F.coalesce(F.right(before, F.lit(1)).rlike("[A-Za-z0-9]"), F.lit(False))).cast("int").alias("alone"), digits.rlike(r"^([0-9])\1*$").cast("int").alias("uniform"),
        )

    def step(state: Column, part: Column) -> Column:
        return F.struct(
            (state["at"] + F.length(part)).alias("at"), (~state["match"]).alias("match"), part.alias("before"),
            F.when(state["match"], F.concat(state["out"], F.array(candidate(state, part, state["before"])))).otherwise(state["out"]).alias("out"),
        )

    def of_parts(parts: Column) -> Column:
        chunk = lambda i: F.slice(parts, i * CHUNK + 1, CHUNK)
        length = lambda i: F.aggregate(chunk(i), F.lit(0), lambda n, part: n + F.length(part))
        later = F.transform(F.sequence(F.lit(1), F.greatest(F.floor((F.size(parts) - 1) / CHUNK).cast("int"), F.lit(1))), lambda i: i - 1)
        starts = F.aggregate(later, F.array(F.lit(0)), lambda at, i: F.concat(at, F.array(F.element_at(at, -1) + length(i))))

        def one(at: Column, i: Column) -> Column:
            start = F.struct(at.alias("at"), F.lit(False).alias("match"), F.lit("").alias("before"), F.array().cast(SPAN).alias("out"))
            return F.aggregate(chunk(i), start, step, lambda x: x["out"])

        return F.when(F.size(parts) <= 1, F.array().cast(SPAN)).when(F.size(parts) <= CHUNK, one(F.lit(0), F.lit(0))).otherwise(F.flatten(F.transform(starts, one)))

    # The array of one binds the parts to a name, so that they are made once.
    found = F.flatten(F.transform(F.array(marked), of_parts))
    if gate:
        found = F.when(F.contains(text, F.lit(gate)), found)
    return F.coalesce(found, F.array().cast(SPAN))


def spans_of(text: Column) -> Column:
    """All candidates of a text with their features, base ones first. U+0001 marks matches; in a text it stands for itself."""
    plain = F.when(F.contains(text, F.lit("\x01")), F.replace(text, F.lit("\x01"), F.lit("\x02"))).otherwise(text)
    return F.flatten(F.transform(F.array(plain), lambda t: F.concat(*[_spans(t, *g) for g in GENERATORS]).cast(SPAN)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and `spans`, the candidates of every row of docs, as a table: they are found once and serve training and selection."""
    rows = texts(docs)
    return materialize(rows.select("doc_id", spans_of(F.col("text")).alias("spans")), "candidates")


@dataclass
class Stump:
    """A tree of depth two: (feature, last value on the left) at the root and on either side; four leaf values."""

    root: tuple[str, int]
    sides: tuple[tuple[str, int], tuple[str, int]]
    leaves: tuple[float, float, float, float]

    def value(self, x: dict[str, int]) -> float:
        right = x[self.root[0]] > self.root[1]
        name, cut = self.sides[right]
        return self.leaves[2 * right + (x[name] > cut)]

    def column(self, span: Column) -> Column:
        def side(i: int) -> Column:
            name, cut = self.sides[i]
            return F.when(span[name] <= cut, self.leaves[2 * i]).otherwise(self.leaves[2 * i + 1])

        return F.when(span[self.root[0]] <= self.root[1], side(0)).otherwise(side(1))


Cell = tuple[dict[str, int], int, int]


@dataclass
class Boosted:
    start: float
    trees: list[Stump]
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self, x: dict[str, int]) -> float:
        return self.start + sum(t.value(x) for t in self.trees)

    def column(self, span: Column) -> Column:
        total = F.lit(self.start)
        for t in self.trees:
            total = total + t.column(span)
        return total

    def calibrate(self, cells: list[Cell], others: list[Cell], precision: float = 0.98) -> None:
        """Per kind the lowest score at which the cells' candidates with that score or more have this precision; a kind that the cells lack takes the others."""
        for kind in range(len(KINDS)):
            good = bad = 0
            self.thresholds[kind] = math.inf
            own = [c for c in cells if c[0]["kind"] == kind] or [c for c in others if c[0]["kind"] == kind]
            scored = sorted(((self.score(x), p, n) for x, p, n in own), reverse=True)
            for i, (s, p, n) in enumerate(scored):
                good, bad = good + p, bad + n
                if good >= precision * (good + bad) and good and (i + 1 == len(scored) or scored[i + 1][0] < s - 1e-9):
                    self.thresholds[kind] = s - 1e-9

    def selects(self, span: Column) -> Column:
        thresholds = F.array(*[F.lit(self.thresholds.get(k, math.inf)) for k in range(len(KINDS))])
        return (span["valid"] == 1) & (self.column(span) >= F.element_at(thresholds, span["kind"] + 1))


def _best(cells: list[tuple[dict, float, float]], features: tuple, ridge: float) -> tuple[float, tuple[str, int]]:
    """The split with the largest gain of (sum of gradients)² / (sum of curvatures)."""
    g_all, h_all = sum(g for _, g, _ in cells), sum(h for _, _, h in cells)
    best = (g_all * g_all / (h_all + ridge), features[0])
    for name, values in features:
        by = [[0.0, 0.0] for _ in range(values)]
        for x, g, h in cells:
            by[x[name]][0] += g
            by[x[name]][1] += h
        g_left = h_left = 0.0
        for cut in range(values - 1):
            g_left, h_left = g_left + by[cut][0], h_left + by[cut][1]
            gain = g_left**2 / (h_left + ridge) + (g_all - g_left) ** 2 / (h_all - h_left + ridge)
            if gain > best[0] + 1e-9:
                best = (gain, (name, cut))
    return best


def boost(cells: list[Cell], features: tuple = FEATURES, rounds: int = 12, rate: float = 0.5, ridge: float = 1.0) -> Boosted | None:
    """cells: (features, positives, negatives); features: those to split on. None without positives."""
    positives, negatives = sum(p for _, p, _ in cells), sum(n for _, _, n in cells)
    if not positives:
        return None
    model = Boosted(math.log((positives + 1) / (negatives + 1)), [])
    scores = [model.start] * len(cells)
    for _ in range(rounds):
        data = []
        for (x, p, n), s in zip(cells, scores):
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, s))))
            data.append((x, p - (p + n) * q, (p + n) * q * (1 - q)))
        root = _best(data, features, ridge)[1]
        halves = [[c for c in data if (c[0][root[0]] > root[1]) == right] for right in (False, True)]
        sides = tuple(_best(h, features, ridge)[1] if h else root for h in halves)
        leaves = []
        for (name, cut), half in zip(sides, halves):
            for right in (False, True):
                part = [c for c in half if (c[0][name] > cut) == right]
                leaves.append(rate * sum(g for _, g, _ in part) / (sum(h for _, _, h in part) + ridge))
        tree = Stump(root, sides, tuple(leaves))
        model.trees.append(tree)
        scores = [s + tree.value(x) for s, (x, _, _) in zip(scores, cells)]
    return model


def train(found: DataFrame) -> Boosted | None:
    """Boosts on the histogram of the candidates' features in three of four documents and calibrates on the further spellings of the
    fourth. Where only that fourth has candidates, it trains as well."""
    names = [n for n, _ in SPLITS]
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False)).alias("held")
    spans = found.select(held, F.explode("spans").alias("s"))
    rows = spans.groupBy("held", *[F.col(f"s.{n}").alias(n) for n in names]).agg(F.sum("s.valid").alias("good"), F.count("*").alias("n")).collect()  # CELLS rows at most
    cells = [(r["held"], ({n: r[n] for n in names}, r["good"], r["n"] - r["good"])) for r in rows]
    own = [c for h, c in cells if not h] or [c for _, c in cells]
    model = boost(own, SPLITS) or boost([c for _, c in cells], SPLITS)
    if model:
        further = lambda x: [c for h, c in cells if h == x and c[0]["form"] == 1]
        model.calibrate(further(True), further(False))
    return model


def base_spans(spans: Column) -> Column:
    """The valid base candidates, sorted by start and kind."""
    return F.array_sort(F.filter(spans, lambda s: (s["form"] == 0) & (s["valid"] == 1)))


def chosen_spans(spans: Column, model: Boosted | None) -> Column:
    """The base spans and those of the further spellings that the model selects and no base span overlaps, sorted likewise."""
    if model is None:
        return base_spans(spans)

    def chosen(base: Column) -> Column:
        added = F.filter(spans, lambda s: (s["form"] == 1) & model.selects(s) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
        return F.array_sort(F.concat(base, added))

    return F.flatten(F.transform(F.array(base_spans(spans)), chosen))


def _listed(spans: str) -> Column:
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and spans of every row of docs."""
    found = candidates(docs)
    model = train(found)
    rows = found.select("doc_id", base_spans(F.col("spans")).alias("base"), chosen_spans(F.col("spans"), model).alias("chosen"))
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("chosen").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """text with each span (sorted by start) replaced by its kind in angle brackets; overlapping spans give one replacement."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.concat(F.lit("<"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), F.lit(">"))))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    joined = F.aggregate(spans, start, step, lambda s: F.concat(F.array_join(s["out"], ""), F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(text.isNotNull() & (F.size(spans) > 0), joined).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans in their texts replaced; all columns stay, whatever their names, and a null text stays null."""
    whole = F.struct(*[F.col(f"`{n}`") for n in docs.columns])
    found = materialize(docs.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), spans_of(F.coalesce("text", F.lit(""))).alias("spans")), "candidates")
    text = redacted(F.col("row.text"), chosen_spans(F.col("spans"), train(found)))
    return found.select(*[(text if n == "text" else F.col("row").getField(n)).alias(n) for n in docs.columns])
