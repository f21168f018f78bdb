"""Quality classifier by positive-unlabelled learning: trusted positives, unlabelled web text and an estimated class prior;
the non-negative unbiased risk is minimised.

The prior is estimated from a first classifier of positives against unlabelled: for each threshold t, the share of
unlabelled above t is at least prior times the share of positives above t, so the least ratio bounds the prior. The second
classifier minimises prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0)) with logistic
loss; where the second part is negative, its gradient is turned round. Its output is the chance of a good text.

Inputs are shape figures of the text, each cut at quantiles of the training sample: shares of letters, capitals, digits, signs and separators, lengths of words and
lines, repetition of words, windows and lines.

Training is on a bounded sample: sample_docs positives and sample_docs unlabelled texts at most (about, by a hash of the id).

Defined cases: null or empty text has a score like every other (all figures 0). Without any positive all scores are 0.5. A document with several labels
counts as a positive if one of them is. Repeated rows are scored each for itself; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .line_rules import SYMBOLS, duplicate_lines, repeated_words

#: Classes of bytes whose shares are inputs.
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", SYMBOLS, b"|", b"!?", b".,;:", b"\n", bytes(range(128, 256)))
_TABLE = np.zeros((len(_CLASSES), 256), bool)
for _i, _c in enumerate(_CLASSES):
    _TABLE[_i, list(_c)] = True
FIGURES = len(_CLASSES) + 10


def figures(column: pa.Array) -> np.ndarray:
    """One row of figures for each text."""
    texts = common.texts_of(column)
    out = np.zeros((len(texts), FIGURES), np.float32)
    for i, j, data, offsets in common.slices(texts):
        size = np.maximum(np.diff(offsets), 1)
        for c in range(len(_CLASSES)):
            total = np.concatenate(([0], np.cumsum(_TABLE[c][data])))
            out[i:j, c] = (total[offsets[1:]] - total[offsets[:-1]]) / size
        starts, ends, first = common.words(data, offsets)
        hashes = common.word_hashes(data, starts, ends)
        length = np.concatenate(([0], np.cumsum(ends - starts)))
        long_ = np.concatenate(([0], np.cumsum(ends - starts > 20)))
        stops = np.concatenate(([0], np.cumsum(np.isin(data[ends - 1], list(b".!?"))))) if len(ends) else np.zeros(1)
        for r, text in enumerate(texts.slice(i, j - i).to_pylist()):
            a, b = first[r], first[r + 1]
            n = int(b - a)
            row = out[i + r, len(_CLASSES) :]
            if not n:
                continue
            _, count = np.unique(hashes[a:b], return_counts=True)
            lines = text.count("\n") + 1
            row[:] = (np.log1p(n), (length[b] - length[a]) / n, (long_[b] - long_[a]) / n, (stops[b] - stops[a]) / n, len(count) / n, count.max() / n, repeated_words(hashes[a:b]) / n, duplicate_lines(text) / lines, np.log1p(n / lines), lines / n)
    return out


class Classifier:
    """A logistic model over figures cut at quantiles."""

    def __init__(self, sample: np.ndarray, bins: int = 12):
        q = np.linspace(0, 1, bins + 1)[1:-1]
        # Cuts at quantiles, and evenly over the range for figures that are mostly equal.
        self.cuts = [np.unique(np.concatenate((np.quantile(sample[:, f], q), np.linspace(sample[:, f].min(), sample[:, f].max(), bins)[1:-1]))) for f in range(sample.shape[1])]
        self.starts = np.concatenate(([0], np.cumsum([len(c) + 1 for c in self.cuts])))
        self.weights = np.zeros(self.starts[-1] + 1)

    def cells(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([self.starts[f] + np.searchsorted(c, rows[:, f], "right") for f, c in enumerate(self.cuts)], 1)

    def raw(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[cells].sum(1) + self.weights[-1]

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.cells(rows)), -50, 50)))

    def gradient(self, cells: np.ndarray, error: np.ndarray) -> np.ndarray:
        g = np.bincount(cells.ravel(), np.repeat(error, cells.shape[1]), len(self.weights))
        g[-1] = error.sum()
        return g

    def fit(self, positives: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 1200, rate: float = 0.05, decay: float = 0.00001) -> Classifier:
        """prior None: positives against unlabelled; else the non-negative risk with this prior."""
        p, u = self.cells(positives), self.cells(unlabelled)
        m, v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        softplus = lambda z: np.logaddexp(0, z)
        for t in range(1, steps + 1):
            zp, zu = self.raw(p), self.raw(u)
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -50, 50))), 1 / (1 + np.exp(-np.clip(zu, -50, 50)))
            as_one = self.gradient(p, (sp - 1) / len(p))
            if prior is None:
                g = as_one + self.gradient(u, su / len(u))
            else:
                rest = softplus(zu).mean() - prior * softplus(zp).mean()
                part = self.gradient(u, su / len(u)) - prior * self.gradient(p, sp / len(p))
                g = prior * as_one + part if rest >= 0 else -part
            g += decay * self.weights
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            self.weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return self


def class_prior(positive_scores: np.ndarray, unlabelled_scores: np.ndarray, least: float = 0.2) -> float:
    """The least ratio of the shares above a threshold, over thresholds that leave the share least of the positives."""
    cuts = np.quantile(positive_scores, np.linspace(0.01, 1 - least, 60))
    p = (positive_scores[None, :] >= cuts[:, None]).mean(1)
    u = (unlabelled_scores[None, :] >= cuts[:, None]).mean(1)
    return float(np.clip((u / np.maximum(p, 1e-9)).min(), 0.05, 0.98))


def train(positives: np.ndarray, unlabelled: np.ndarray) -> tuple[Classifier | None, float]:
    """The classifier and the class prior that it was trained with."""
    if not len(positives) or not len(unlabelled):
        return None, 0.5
    both = np.concatenate((positives, unlabelled))
    # Half the sample trains the first classifier, the other half gives the scores for the prior.
    first = Classifier(both).fit(positives[::2], unlabelled[::2], None)
    halves = (positives[1::2], unlabelled[1::2]) if min(len(positives), len(unlabelled)) > 1 else (positives, unlabelled)
    prior = class_prior(first.score(halves[0]), first.score(halves[1]))
    return Classifier(both).fit(positives, unlabelled, prior), prior


def figures_of(docs: DataFrame, most: int) -> np.ndarray:
    """The figures of a bounded sample (most rows at most, equal ones once), on the driver, in the order of a hash: the same however the table is partitioned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(figures(batch.column(1))), pa.list_(pa.float32()))], ["key", "figures"])

    rows = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text").dropDuplicates(["key"])
    found = rows.transform(common.in_batches, run, "key long, figures array<float>").orderBy("key").limit(most).toPandas()["figures"]
    return np.stack(found.to_list()) if len(found) else np.zeros((0, FIGURES), np.float32)


def score_quality(docs: DataFrame, labels: DataFrame, learn_from: Column | None = None, sample_docs: int = 8000, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, score, predicted. learn_from: a condition on the id for labels and unlabelled texts that may be used. labels: the positives are those whose label is 1."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    usable = F.lit(True) if learn_from is None else learn_from
    near = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    good = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(F.col("label") == 1).where(usable).select("doc_id").distinct()
    n_good, n_all = good.count(), slim.count()
    chosen = good.where(near < sample_docs / max(n_good, 1))  # about sample_docs ids at most, so small enough for every executor
    positives = figures_of(slim.join(F.broadcast(chosen), "doc_id", "left_semi"), 2 * sample_docs)
    unlabelled = figures_of(slim.where(usable).where(1 - near <= sample_docs / max(n_all, 1)), 2 * sample_docs)
    model, _ = train(positives, unlabelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(figures(batch.column(1))) if model else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], ["doc_id", "score", "predicted"])

    return slim.transform(common.in_batches, run, "doc_id long, score double, predicted int")
