"""Language identification of mixed text: script ranges narrow the candidates, per-word scores of letter trigrams rate them,
and a Viterbi path with a penalty for each switch labels the spans.

A word is a run of letters of one script. A language is a candidate for a script if a fair share of its training letters
belong to it; for a script that no language has, all are. The label of a document is the language that holds most of its
letters; its score is that share times the posterior of the language among all. Beside it, identify_rows tells how sure the spans are: the
posterior of each span's language over the span's own words, as a mean over letters, in however many languages the text is.

Defined cases: null text, or text without a letter: lang `und`, score 0, no spans. Without any training row every
document is `und`. Ties go to the language whose name sorts first. A null lang is not learned from. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: First code points of runs of letters and their script; what lies between known ranges counts as "other".
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "other"), (0x0B80, "tamil"),
    (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
BUCKETS = 1 << 16


@cache
def _letter_script() -> np.ndarray:
    """For each code point 0 if it is no letter, else 1 + its script."""
    starts = np.array([a for a, _ in SCRIPTS])
    ids = np.array([NAMES.index(b) for _, b in SCRIPTS], np.int8)
    points = np.arange(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in range(0x110000)), bool, 0x110000)
    return np.where(letter, 1 + ids[np.searchsorted(starts, points, "right") - 1], 0).astype(np.int8)


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the concatenated texts: places of letters, their trigram buckets and scripts; the first letter (index) of each word; the first word and first code point of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    joined = "\0".join(texts) + "\0"
    # Letters are compared in lower case; the few whose lower case is longer stay as they are.
    # (A final sigma isn't told apart: what one text holds never depends on the others.)
    low = joined.replace("Σ", "σ").lower()
    if len(low) != len(joined):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in joined)
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    script = _letter_script()[np.minimum(points, 0x10FFFF)]
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    at = np.flatnonzero(script)
    before = np.concatenate((np.zeros(1, np.int8), script[:-1]))
    after = np.concatenate((script[1:], np.zeros(1, np.int8)))
    own = script[at]
    first = own != before[at]
    prev = np.where(first, 0, points[at - 1]).astype(np.uint64)
    nxt = np.where(after[at] == own, points[np.minimum(at + 1, len(points) - 1)], 0).astype(np.uint64)
    key = (prev << np.uint64(42)) | (points[at].astype(np.uint64) << np.uint64(21)) | nxt
    bucket = (common.mix(key) >> np.uint64(48)).astype(np.int64)
    starts = np.flatnonzero(first)
    return at, bucket, own - 1, starts, np.searchsorted(at[starts], begins), begins


class Model:
    """Log probabilities of trigram buckets by language, and which scripts a language is written in."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, least_script: float = 0.005):
        self.langs = langs
        total = counts.sum(0, keepdims=True)
        self.logp = np.log((counts + 0.05) / (total + 0.05 * BUCKETS)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0, keepdims=True), 1)
        allowed = share >= least_script
        allowed[~allowed.any(1)] = True
        self.extra = np.where(allowed, 0, -25).astype(np.float32)

    def word_scores(self, bucket: np.ndarray, script: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.logp[bucket] + self.extra[script], starts, axis=0, dtype=np.float64)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best label for each word. If no stretch of words gains the penalty over the best single label, that label is the path."""
    best = int(scores.sum(0).argmax())
    others = np.delete(scores, best, 1)
    if not others.shape[1]:
        return np.zeros(len(scores), np.int64)
    gain = np.concatenate(([0.0], np.cumsum(others.max(1) - scores[:, best])))
    if (gain - np.minimum.accumulate(gain)).max() <= penalty:
        return np.full(len(scores), best)
    state = scores[0].tolist()
    n = len(state)
    back = np.empty((len(scores), n), np.int64)
    for t, row in enumerate(scores[1:].tolist(), 1):
        top = max(state)
        k = state.index(top)
        top -= penalty
        for i in range(n):
            stay = state[i]
            back[t, i] = i if stay >= top else k
            state[i] = (stay if stay >= top else top) + row[i]
    path = np.empty(len(scores), np.int64)
    path[-1] = k = state.index(max(state))
    for t in range(len(scores) - 1, 0, -1):
        path[t - 1] = k = back[t, k]
    return path


def sampled(docs: DataFrame, train_docs: int) -> DataFrame:
    """About train_docs documents of each language, or all if there are fewer, chosen by a hash of the id."""
    counts = {r["lang"]: r["n"] for r in docs.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not any(n > train_docs for n in counts.values()):
        return docs
    rate = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, train_docs / n))))
    return docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < rate[F.col("lang")] * 1_000_003)


def train(docs: DataFrame, train_docs: int = 5000) -> Model:
    """Learn from text and lang of about train_docs documents of each language (the bound of the training sample)."""
    docs = docs.where("lang is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs):
                counts = found.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                mine = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                for i in range(0, len(mine), 200):
                    _, bucket, script, *_ = letters(mine[i : i + 200])
                    counts[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                    counts[BUCKETS:] += np.bincount(script, minlength=len(NAMES))
        for lang, counts in found.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "feature", "n"])

    langs = [r[0] for r in docs.select("lang").distinct().orderBy("lang").collect()]
    counts = sampled(docs, train_docs).select("text", "lang").transform(common.in_batches, run, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros((BUCKETS + len(NAMES), len(langs)))
    table[counts["feature"].to_numpy(np.int64), counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64) if len(counts) else []] = counts["n"].to_numpy(np.float64)
    return Model(langs, table[:BUCKETS], table[BUCKETS:])


def label(text_batch: list[str], model: Model, penalty: float) -> list[tuple[str, float, list[dict], float | None]]:
    """(language, score, spans of code points, certainty of the spans) for each text. Certainty is 0 without a letter, None if nothing was learned to judge letters by."""
    at, bucket, script, starts, first, begins = letters(text_batch)
    if not len(starts) or not model.langs:
        return [("und", 0.0, [], None if a < b else 0.0) for a, b in zip(first, first[1:], strict=False)]
    scores = model.word_scores(bucket, script, starts)
    sizes = np.diff(np.append(starts, len(at)))
    ends = at[starts + sizes - 1] + 1
    out = []
    for r in range(len(text_batch)):
        a, b = first[r], first[r + 1]
        if a == b:
            out.append(("und", 0.0, [], 0.0))
            continue
        path = viterbi(scores[a:b], penalty)
        held = np.bincount(path, sizes[a:b], len(model.langs))
        best = int(held.argmax())
        total = scores[a:b].sum(0)
        posterior = 1 / np.exp(np.minimum(total - total[best], 700)).sum()
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(path)) + 1))
        lasts = np.append(cuts[1:], b - a) - 1
        spans = [{"start": int(at[starts[a + c]] - begins[r]), "end": int(ends[a + e] - begins[r]), "lang": model.langs[path[c]]} for c, e in zip(cuts, lasts, strict=True)]
        # Each span is judged by its own words.
        own = np.add.reduceat(scores[a:b], cuts, axis=0)
        sure = 1 / np.exp(np.minimum(own - own[np.arange(len(cuts)), path[cuts]][:, None], 700)).sum(1)
        certainty = float(np.average(sure, weights=np.add.reduceat(sizes[a:b], cuts)))
        out.append((model.langs[best], float(held[best] / held.sum() * posterior), spans, certainty))
    return out


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(docs: DataFrame, learn_from: Column | None = None, train_docs: int = 5000, penalty: float = 15.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score, spans for each document. learn_from: which rows may be learned from (all with a lang if None)."""
    known = docs if learn_from is None else docs.where(learn_from)
    model = train(known.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts_of(batch.column(1))
            for i, j, _, _ in common.slices(texts):
                lang, score, spans, _ = zip(*label(texts.slice(i, j - i).to_pylist(), model, penalty), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(spans, SPANS)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(common.in_batches, run, "doc_id long, lang_pred string, score double, spans array<struct<start: long, end: long, lang: string>>")


def identify_rows(docs: DataFrame, names: tuple[str, str, str] = ("_lang_pred", "_lang_score", "_lang_certainty"), train_docs: int = 5000, penalty: float = 15.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with the prediction, its score and the certainty of the spans beside each row, under names that docs doesn't have yet; all columns stay as they are."""
    model = train(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")), train_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = common.texts_of(batch.column(at).cast(pa.string()))
            for i, j, _, _ in common.slices(texts):
                lang, score, _, sure = zip(*label(texts.slice(i, j - i).to_pylist(), model, penalty), strict=True)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())], [*part.schema.names, *names])

    return docs.transform(common.in_batches, run, T.StructType([*docs.schema.fields, *(T.StructField(n, t) for n, t in zip(names, (T.StringType(), T.DoubleType(), T.DoubleType()), strict=True))]))
