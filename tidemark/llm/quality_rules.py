"""Quality rules as a bitmask ledger.

`ledger` evaluates every rule once per document and stores the measurements and one bit for each failed rule. A policy is a
mask of the rules that count under a version; `apply_policy` decides by one bitwise and, and `ablation` finds what each rule
rejects alone, by bitwise aggregation over the ledger instead of another pass over the texts.

Defined results: a null text counts as empty and has no words; it fails `short`. Rows with equal doc_id, and equal rows, stay separate
rows; there are no ties to break. A null doc_id passes through. Very long texts are measured whole, one at a time; an empty table gives an
empty ledger, and an ablation of zeros; only doc_id and text are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, texts

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bars", "longest_word")
#: Name of each rule and the SQL condition under which it fails, in the order of the bits.
RULES = (
    ("short", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 10 * greatest(word_chars, 1)"),
    ("duplicate_lines", "100 * n_dup_lines > 30 * greatest(n_lines, 1)"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 14 * n_words)"),
    ("upper_case", "2 * n_upper > n_letters and n_letters > 0"),
    ("bars", "n_words > 0 and 100 * n_bars > 15 * n_words"),
    ("long_word", "longest_word > 200"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
#: Versioned policies: the rules that reject a document.
POLICIES = {
    "base": BIT["short"] | BIT["repeated_words"],
    "v1": sum(BIT.values()),
}
SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
ARROW = pa.schema([("doc_id", pa.int64()), *((m, pa.int64()) for m in MEASURES)])
SYMBOLS = b"#*$%&|<>"
LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window which the text has twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    code: dict[bytes, int] = {}
    x = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, len(words))
    if len(code) < 1 << 21:
        window = (x[:-2] << 42) | (x[1:-1] << 21) | x[2:]
    else:
        pair = np.unique((x[:-2] << 32) | x[1:-1], return_inverse=True)[1]
        window = (pair << 32) | x[2:]
    _, at, counts = np.unique(window, return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + n] |= again
    return int(covered.sum())


def measure(text: bytes) -> tuple[int, ...]:
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    joined = b"".join(words)
    continued = len(joined.translate(None, CONTINUATION))
    upper = len(joined) - len(joined.translate(None, LETTERS[:26]))
    return (
        len(words), continued, len(joined) - len(joined.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat_words(words),
        len(lines), upper, len(joined) - len(joined.translate(None, LETTERS)), words.count(b"|"), max(map(len, words), default=0),
    )


CONTINUATION = bytes(range(128, 192))


def _measure(batches):
    for part in slices(batches):
        rows = [measure(t) for t in raw(part.column("text"))]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows))], schema=ARROW)


def ledger(docs: DataFrame) -> DataFrame:
    """doc_id, all measurements and `failed`, the bits of the failed rules."""
    bits = [F.when(F.expr(condition), F.lit(BIT[name])).otherwise(0) for name, condition in RULES]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return texts(docs).mapInArrow(_measure, SCHEMA).withColumn("failed", failed.cast("long"))


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    return rows.withColumn("kept", F.col("failed").bitwiseAND(POLICIES[version]) == 0)


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of the policy: how many documents fail it, and how many would stay if it alone were dropped."""
    mask = POLICIES[version]
    hit = F.col("failed").bitwiseAND(mask)
    names = [n for n, _ in RULES if BIT[n] & mask]
    counts = rows.agg(*[F.count_if(hit.bitwiseAND(BIT[n]) != 0).alias(f"{n}_f") for n in names], *[F.count_if(hit == BIT[n]).alias(f"{n}_a") for n in names])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"{n}_f").alias("failed"), F.col(f"{n}_a").alias("failed_alone")) for n in names])))
