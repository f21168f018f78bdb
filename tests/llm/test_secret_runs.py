"""The judge of long tokens against a plain restatement, and its time on tokens of a megabyte."""

import random
import string
import time

import numpy as np
import pytest

from tests.llm import brute
from tidemark.llm import secrets


def maximal_runs(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring runs by their definition: the best run (the shortest of equals), then the same to its left and right."""

    def of(a: int, b: int) -> list[tuple[int, int]]:
        best = max(((sum(scores[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, _, i, j = best
        return of(a, i) + [(i, j)] + of(j, b)

    return of(0, len(scores))


def judged_plainly(token: str, ratio: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    whole = float(ratio[secrets.trigrams(token)].mean())
    if secrets.mixed(token) and whole >= threshold:
        return [(0, len(token), whole)]
    parts = list(secrets.PART.finditer(token))
    sums = [float(ratio[secrets.trigrams(m[0])].sum()) for m in parts]
    out = []
    for i, j in maximal_runs([s - threshold * len(m[0]) for s, m in zip(sums, parts)]):
        n = sum(len(m[0]) for m in parts[i:j])
        if parts[j - 1].end() - parts[i].start() >= secrets.LEAST:
            out.append((parts[i].start(), parts[j - 1].end(), max(sum(sums[i:j]) / n, threshold)))
    return out


def models(seed: int) -> np.ndarray:
    """Ratios with sixteenths only, so sums are exact and ties occur."""
    return (np.random.default_rng(seed).integers(-32, 40, secrets.N**3) / 16).astype(np.float32)


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_their_definition(seed):
    r, ratio = random.Random(seed), models(seed)
    for _ in range(150):
        token = r.choice("-_/=").join("".join(r.choices(string.ascii_lowercase, k=r.choice((1, 2, 4, 9)))) for _ in range(r.randrange(1, 14)))
        got, want = secrets.judged(token, ratio, 0.5), judged_plainly(token, ratio, 0.5)
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert all(abs(g[2] - w[2]) < 1e-6 for g, w in zip(got, want))


@pytest.mark.parametrize("shift", [-1.0, 0.0, 1.0, 3.0])
def test_a_megabyte_in_one_token(shift):
    r = random.Random(1)
    token = "-".join("".join(r.choices(string.ascii_lowercase, k=r.randrange(2, 12))) for _ in range(140_000))
    began = time.process_time()
    secrets.judged(token, models(9) + np.float32(shift), 1.0)
    assert len(token) > 1_000_000 and time.process_time() - began < 4


def test_added_spans_of_documents(spark):
    """Whole rows of the operator against base spans, what they leave, and the plain judge."""
    r = random.Random(3)
    word = lambda: r.choice(("river", "stone-bridge", "market_place", "garden"))
    random_ = lambda: "".join(r.choices(string.ascii_letters + string.digits, k=r.randrange(16, 40)))
    rows = [(i, " ".join(word() if r.random() < 0.9 else r.choice((random_(), f"token={random_()}", "-".join(random_() for _ in range(4)), f"{r.getrandbits(128):032x}")) for _ in range(30))) for i in range(60)]
    df = spark.createDataFrame([*rows, (99, None)], "doc_id long, text string")
    spans = secrets.candidates(df)
    ratio = secrets.train(df, spans)
    for got in secrets.secret_spans(df).collect():
        text = dict(rows).get(got["doc_id"]) or ""
        base = brute.secrets_base(text)
        want, at = [(a, b, k) for k, a, b in base], 0
        for a, b in [*sorted((a, b) for _, a, b in base), (len(text), len(text))]:
            want += [(m.start() + x, m.start() + y, "random") for m in secrets.TOKEN.finditer(text, at, a) for x, y, _ in judged_plainly(m[0], ratio, 1.0)]
            at = max(at, b)
        order = ("assign", "access", "hex", "random")
        assert [(s["start"], s["end"], s["kind"]) for s in got["spans"]] == sorted(want, key=lambda s: (s[0], order.index(s[2])))
