"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics. Per class the mean and the covariance come from sums that Spark adds
up over labelled training rows (all, or a sample by hash where they are more than MOST_LABELS); the covariance is shrunk towards the
pooled one and a scaled identity. A score is the logistic of the difference of the two Mahalanobis log densities, computed with
Cholesky factors that are made once. Texts are scored whole, one at a time, in one pass over the table.

Defined results: a null text counts as empty; a label whose quality is null or whose doc_id is null, and a document without a label,
teach nothing; of several labels of one doc_id the largest counts. A class without training rows borrows the other's covariance and
the standard normal mean, so that scores stay defined. Repeated doc_ids are scored row by row, and a label teaches each of them; equal
texts get equal scores. An empty table gives an empty one. Further columns of any name pass through `drop_low_quality` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import raw, slices, texts
from .quality_rules import measure

FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "letters", "bars", "distinct", "doubled", "exclamations", "log_longest")
D = len(FEATURES)
#: Labelled training rows that teach, about, where there are more: a sample by hash, which bounds what is broadcast. The model has 2 (D + 1)² sums.
MOST_LABELS = 50_000


def features(text: bytes) -> list[float]:
    """Square roots and logarithms bring the rates near to a normal shape."""
    n, chars, symbols, dups, repeats, lines, upper, letters, bars, longest = measure(text)
    words, w = text.split(), max(n, 1)
    c = max(chars, 1)
    return [
        np.log1p(n), np.log1p(chars / w), np.sqrt(symbols / c), np.sqrt(dups / max(lines, 1)), np.sqrt(repeats / w), np.sqrt(upper / max(letters, 1)),
        letters / c, np.sqrt(bars / w), np.log((len(set(words)) + 1) / (w + 1)), _doubled(words), np.sqrt(text.count(b"!") / w), np.log1p(longest),
    ]


def _doubled(words: list[bytes]) -> float:
    """Share of words that equal their predecessor."""
    return float(np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / max(len(words), 1)))


def _matrix(texts: list[bytes]) -> np.ndarray:
    return np.array([features(t) for t in texts], np.float64).reshape(-1, D)


def _sums(batches):
    """Of labelled texts, per class n, the sums and the sums of products of their features, as cells; one set of cells a task."""
    total = np.zeros((2, D + 1, D + 1))
    for part in slices(batches):
        y = part.column("label").to_numpy(zero_copy_only=False).astype(int)
        x = _matrix(raw(part.column("text")))
        z = np.hstack([np.ones((len(x), 1)), x])
        for c in (0, 1):
            total[c] += z[y == c].T @ z[y == c]
    c, i, j = np.indices(total.shape)
    yield pa.RecordBatch.from_arrays([pa.array(a.ravel().astype(np.int32)) for a in (c, i, j)] + [pa.array(total.ravel())], names=["c", "i", "j", "v"])


@dataclass
class Qda:
    """Per class: mean, inverse of the Cholesky factor, half the log determinant, log prior."""

    means: np.ndarray
    inverses: np.ndarray
    half_logdets: np.ndarray
    log_priors: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(1) - h + p for m, w, h, p in zip(self.means, self.inverses, self.half_logdets, self.log_priors)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -60, 60)))


def fit(labelled: DataFrame, shrink: float = 0.2, ridge: float = 0.02) -> Qda:
    """labelled: text and label (0 or 1). shrink: weight of the pooled covariance; ridge: weight of the scaled identity."""
    cells = labelled.select("text", "label").mapInArrow(_sums, "c int, i int, j int, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect()  # 2 (D+1)² rows
    total = np.zeros((2, D + 1, D + 1))
    for c, i, j, v in cells:
        total[c, i, j] = v
    n = total[:, 0, 0]
    if not n.sum():
        total[:] = np.eye(D + 1)
        n = total[:, 0, 0]
    means = total[:, 0, 1:] / np.maximum(n, 1)[:, None]
    scatter = np.stack([total[c, 1:, 1:] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)])
    pooled = scatter.sum(0) / max(n.sum() - 2, 1)
    scale = np.diag(np.maximum(np.diag(pooled), 1e-6))
    inverses, half = [], []
    for c in (0, 1):
        own = scatter[c] / (n[c] - 1) if n[c] > 1 else pooled
        cov = (1 - ridge) * ((1 - shrink) * own + shrink * pooled) + ridge * scale + 1e-6 * np.eye(D)
        lower = np.linalg.cholesky(cov)
        inverses.append(np.linalg.inv(lower))
        half.append(float(np.log(np.diag(lower)).sum()))
    return Qda(means, np.stack(inverses), np.array(half), np.log((n + 1) / (n.sum() + 2)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def taught_labels(labels: DataFrame, most: int) -> DataFrame:
    """doc_id and label of the labels that may teach: about `most` of them, chosen by a hash of doc_id, where there are more."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    known = known.filter(~held_out(F.col("doc_id")))
    share = most / max(known.count(), 1)
    return known if share >= 1 else known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) < int(share * (1 << 32)))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Qda:
    """The labels, of a bounded number, go to the texts, so that no text is shuffled and only taught ones are measured."""
    return fit(texts(docs).join(F.broadcast(taught_labels(labels, most)), "doc_id"))


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of docs; labels of held-out rows are never read."""
    model = train(docs, labels, most_labels)

    def score(batches):
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.score(_matrix(raw(part.column("text")))))], names=["doc_id", "score"])

    scored = texts(docs).mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_labels: int = MOST_LABELS) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns. Each row is decided by its own text in the pass that
    carries it, so rows without a doc_id, or with a repeated one, don't decide on each other."""
    model = train(docs, labels, most_labels)

    def keep(batches):
        for part in slices(batches):
            found = raw(part.column("text").fill_null(""))
            yield part.filter(pa.array(model.score(_matrix(found)) >= threshold))

    return docs.mapInArrow(keep, docs.schema)
