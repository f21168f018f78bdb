"""Secrets in text: fixed patterns, and character Markov models of random strings and of ordinary identifiers compared by
log-likelihood ratio.

Both models are of second order: the chance of a character given the two before it, over classes of the characters that
tokens are made of, smoothed by the first-order chance. They are trained from labelled samples: a token is
labelled random if a fixed pattern found it (an assigned value that mixes letters and digits, an access key, a hexadecimal run), or comes
from the generated ones; ordinary samples are the words of a bounded sample of documents that
the models won't have to judge, and runs of one character. Every run of 16 token characters or more between the base spans is judged: as a
whole, if it mixes letters and digits, and else by its parts between separators. What has a mean log-likelihood ratio
for each character over the threshold, and is long enough, is reported as `random`: the whole, or the runs of parts in which the ratios exceed the threshold most.

Defined cases: null or empty text: no spans. Texts of any length are read whole; positions count code points. Without
ordinary words in the sample the ordinary model is uniform. Repeated rows are handled each for itself; other columns are ignored.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Base patterns in the order of reporting. Keywords match in either case of ASCII letters only.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")
#: What may be a secret without a keyword: long runs of token characters.
LEAST = 16
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
PART = re.compile(r"[A-Za-z0-9]+")
WORD = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
#: Letters in both cases, digits, one class for signs, one for the start.
CLASSES = string.ascii_lowercase + string.ascii_uppercase + string.digits + "-"
N = len(CLASSES) + 1
_CODE = np.full(128, N - 2, np.int64)
for _i, _c in enumerate(CLASSES):
    _CODE[ord(_c)] = _i


def codes(token: str) -> np.ndarray:
    return _CODE[np.frombuffer(token.encode("ascii"), np.uint8)]


def trigrams(token: str) -> np.ndarray:
    """Index of (two before, before, character) for each character; the start class stands before the first."""
    c = np.concatenate(([N - 1, N - 1], codes(token)))
    return (c[:-2] * N + c[1:-1]) * N + c[2:]


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) by start, then kind."""
    # A match consumes its text also if its value is too short for a secret.
    out = [(m.start(), m.end(), "assign", m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def mixed(token: str) -> bool:
    """Whether the token has a digit and a letter."""
    return any("0" <= c <= "9" for c in token) and any(c.isalpha() for c in token)


def other_tokens(text: str, base: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """The long runs of token characters in what the base spans leave."""
    out, at = [], 0
    for a, b in [*sorted((a, b) for a, b, _, _ in base), (len(text), len(text))]:
        out += [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, at, a)]
        at = max(at, b)
    return out


def judged(token: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """(start, end, score) in the token of what the models call random: the token, or else the maximal runs of its parts."""
    if mixed(token) and (score := float(ratio[trigrams(token)].mean())) >= threshold:
        return [(0, len(token), score)]
    # Runs of parts with the largest sums over the threshold (Ruzzo and Tompa), in linear time. A run: start, end, the sum and the characters before it, those after it, and
    # the place of the last run with a smaller sum before it (runs between need not be looked at again).
    runs: list[tuple[int, int, float, int, float, int, int]] = []
    total, chars = 0.0, 0
    for m in PART.finditer(token):
        found, n = float(ratio[trigrams(m[0])].sum()), m.end() - m.start()
        before, total = total, total + found - threshold * n
        chars += n
        if total <= before:
            continue
        start, low, behind, j = m.start(), before, chars - n, len(runs) - 1
        while True:
            while j >= 0 and runs[j][2] >= low:
                j = runs[j][6]
            if j < 0 or runs[j][4] >= total:
                break
            start, _, low, behind, _, _, left = runs[j]
            del runs[j:]
            j = left
        runs.append((start, m.end(), low, behind, total, chars, j))
    return [(a, b, max((high - low + threshold * (after - behind)) / (after - behind), threshold)) for a, b, low, behind, high, after, _ in runs if b - a >= LEAST]


SPAN = "array<struct<start: long, end: long, kind: string, value: string>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: base spans and, with an empty kind, the tokens that the models have to judge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in common.texts_of(batch.column(1)).to_pylist():
                base = base_spans(text)
                found.append([{"start": a, "end": b, "kind": k, "value": v} for a, b, k, v in base] + [{"start": a, "end": b, "kind": "", "value": v} for a, b, v in other_tokens(text, base)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPAN_TYPE)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(common.in_batches, run, f"doc_id long, spans {SPAN}")


def generated(n: int = 4000, seed: int = 7) -> list[str]:
    """Labelled samples of random strings: keys and tokens over the usual alphabets."""
    r = random.Random(seed)
    kinds = (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, "0123456789abcdef", "0123456789ABCDEF", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "-_", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits)
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(16, 48))) for i in range(n)]


def counted(tokens: list[str]) -> np.ndarray:
    out = np.zeros(N**3, np.int64)
    for i in range(0, len(tokens), 5000):
        out += np.bincount(np.concatenate([trigrams(t) for t in tokens[i : i + 5000]]), minlength=N**3)
    return out


def counts_of(batches: Iterator[list[str]], label: int) -> pa.RecordBatch:
    """How often each trigram comes in the batches' tokens, as rows (label, gram, n)."""
    total, held, size = np.zeros(N**3, np.int64), [], 0
    for tokens in batches:
        held += [trigrams(t) for t in tokens]
        size += sum(map(len, tokens))
        if size > 1_000_000:
            total += np.bincount(np.concatenate(held), minlength=N**3)
            held, size = [], 0
    if held:
        total += np.bincount(np.concatenate(held), minlength=N**3)
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.int32()), pa.array(at, pa.int32()), pa.array(total[at])], ["label", "gram", "n"])


def log_chances(counts: np.ndarray) -> np.ndarray:
    """Second-order log chances, backed off to first order, to the single character, to the uniform."""
    c3 = counts.reshape(N, N, N).astype(float)
    c2 = c3.sum(0)
    c1 = c2.sum(0)
    p1 = (c1 + 0.5) / (c1.sum() + 0.5 * N)
    p2 = (c2 + 20 * p1) / (c2.sum(1, keepdims=True) + 20)
    return np.log((c3 + 20 * p2) / (c3.sum(2, keepdims=True) + 20)).reshape(-1)


def train(docs: DataFrame, spans: DataFrame, sample_docs: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log-likelihood ratios by trigram. sample_docs: about how many documents' words are the ordinary samples (the bound of the training sample, by a hash of the id)."""

    def plain(text: str) -> list[str]:
        found = WORD.findall(HEX.sub(" ", ACCESS.sub(" ", ASSIGN.sub(" ", text))))
        # What may be judged isn't learned: long parts, and long runs of letters and digits.
        return [p for w in dict.fromkeys(found) if len(w) < LEAST or not mixed(w) for p in ([w] if len(w) < LEAST else PART.findall(w)) if 4 <= len(p) < LEAST]

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield counts_of((plain(text) for batch in batches for text in common.texts_of(batch.column(0)).to_pylist()), 0)

    def secrets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield counts_of((batch.column(0).to_pylist() for batch in batches), 1)

    n = docs.count()
    schema = "label int, gram int, n long"
    some = docs if n <= sample_docs else docs.where(F.coalesce(F.pmod(F.xxhash64(id_col), F.lit(1_000_003)) < 1_000_003 * sample_docs / n, F.lit(False)))
    ordinary = some.select(F.col(text_col).cast("string").alias("text")).transform(common.in_batches, words, schema)
    labelled = spans.select(F.explode("spans").alias("s")).where("s.kind <> '' and s.value rlike '[0-9]' and s.value rlike '[A-Za-z]' and length(s.value) >= 16").select("s.value")
    per_gram = ordinary.union(labelled.transform(common.in_batches, secrets, schema)).groupBy("label", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, N**3), np.int64)
    counts[per_gram["label"].to_numpy(np.int64), per_gram["gram"].to_numpy(np.int64)] = per_gram["n"].to_numpy(np.int64)
    counts[0] += counted([c * 4 for c in CLASSES])
    counts[1] += counted(generated())
    return (log_chances(counts[1]) - log_chances(counts[0])).astype(np.float32)


def secret_spans(docs: DataFrame, threshold: float = 1.0, sample_docs: int = 5000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: array of (start, end, kind, base, score) by start, then kind. score: the log-likelihood ratio for each character of the value."""
    spans = common.saved(candidates(docs, id_col, text_col), "secrets")
    ratio = train(docs, spans, sample_docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_()), ("score", pa.float64())]))
        for batch in batches:
            found = []
            for row in batch.column(1).to_pylist():
                out = []
                for s in row:
                    if s["kind"]:
                        out.append({"start": s["start"], "end": s["end"], "kind": s["kind"], "base": True, "score": float(ratio[trigrams(s["value"])].mean())})
                    else:
                        out += [{"start": s["start"] + a, "end": s["start"] + b, "kind": "random", "base": False, "score": x} for a, b, x in judged(s["value"], ratio, threshold)]
                order = (*BASE, "random")
                found.append(sorted(out, key=lambda s: (s["start"], order.index(s["kind"]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return spans.transform(common.in_batches, run, "doc_id long, spans array<struct<start: long, end: long, kind: string, base: boolean, score: double>>")


def redact(docs: DataFrame, threshold: float = 1.0, sample_docs: int = 5000, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each secret in the text replaced by the mark; overlapping spans are one. All columns stay; null texts stay null."""
    ratio = train(docs, common.saved(candidates(docs, id_col, text_col), "secrets"), sample_docs, id_col, text_col)

    def clean(text: str) -> str:
        base = base_spans(text)
        found = [(a, b) for a, b, _, _ in base] + [(at + a, at + b) for at, _, v in other_tokens(text, base) for a, b, _ in judged(v, ratio, threshold)]
        out, at = [], 0
        for a, b in sorted(found):
            if a >= at:
                out += [text[at:a], mark]
            at = max(at, b)
        return "".join([*out, text[at:]]) if found else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(text_col)
            texts = pa.array([None if t is None else clean(t) for t in batch.column(i).to_pylist()], pa.string())
            yield batch.set_column(i, pa.field(text_col, pa.string()), texts)

    typed = docs.withColumn(text_col, F.col(text_col).cast("string"))
    return typed.transform(common.in_batches, run, typed.schema)
