"""The queries opN_<name> as they are registered, on the fixture written as Parquet, against plain restatements of their contracts."""

import base64
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm import brute, fixtures
from tests.llm.test_operators import jaccard_classes
from tidemark.llm import queries

ROWS = fixtures.documents(60)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    fixtures.frame(spark, ROWS).write.parquet(str(path / "documents.parquet"))
    labels = [(r[0], int(len(r[1] or "") > 500)) for r in ROWS if r[0] is not None and r[0] % 2]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def held(n, remainder):
    return {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % n == remainder for r in ROWS}


@pytest.mark.parametrize("name, base, order", [("op1_pii", brute.pii_base, ("email", "ip", "card", "phone")), ("op2_secrets", brute.secrets_base, ("assign", "access", "hex"))])
def test_spans(spark, folder, name, base, order):
    want = Counter()
    for i, text, *_ in ROWS:
        spans = base(text)
        want[i, *(sum(s[0] == k for s in spans) for k in order), brute.sha(brute.joined(spans))] += 1
    got = queries.QUERIES[name](spark, folder).collect()
    assert Counter(tuple(r)[: 2 + len(order)] for r in got) == want
    for r in got:
        found = [s.split(":") for s in r["spans"].split(",") if s]
        assert all(len(s) == 3 and int(s[1]) < int(s[2]) for s in found)
        assert brute.sha(brute.joined(s for s in found if s[0] in order)) == r["base_sha256"]


def test_languages(spark, folder):
    got = queries.op3_language_id(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert all(r["held_out"] == held(3, 1)[r["doc_id"]] and r["lang_pred"] in ("en", "de", "ru", "und") and 0 <= r["score"] <= 1 for r in got)


def test_tokens(spark, folder):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(tuple(r)[:4] for r in queries.op5_bpe(spark, folder).collect()) == want


def test_mix_and_lines(spark, folder):
    ids = Counter(r[0] for r in ROWS)
    assert Counter(r["doc_id"] for r in queries.op6_pfair_mix(spark, folder).collect()) == ids
    lines = queries.op7_line_rules(spark, folder)
    assert "cleaned" not in lines.columns and Counter(r["doc_id"] for r in lines.collect()) == ids


def test_scores(spark, folder):
    got = queries.op9_quality(spark, folder).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ROWS)
    assert all(r["held_out"] == held(5, 0)[r["doc_id"]] and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_ngram_join(spark, folder):
    want = jaccard_classes([(r[0], r[1]) for r in ROWS], 4, 85)
    got = queries.op10_ngram_join(spark, folder).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == Counter(want)


def test_archives(spark, tmp_path):
    """Nulls, empty, repeated and long pages, page ids that repeat, columns that clash."""
    pages = [(i, f"https://x/{i}", h) for i, h in enumerate(["<p>a</p>", None, "", "<p>a</p>", "ü" * 5, "x" * 300_000, "<p>b</p>", "ü" * 5])] + [(6, "again", "<p>b</p>"), (20, None, "<p>a</p>")]
    spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, payload_digest string, offset int").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), i)
    got = queries.op4_warc(spark, str(tmp_path)).collect()
    assert len(got) == len(pages) and Counter(r["page_id"] for r in got) == Counter(p[0] for p in pages)
    html = {(i, len((h or "").encode())): h or "" for i, _, h in pages}
    for r in got:
        h = html[r["page_id"], r["payload_bytes"]]
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(h.encode()).digest()).decode()
        if Counter(p[0] for p in pages)[r["page_id"]] == 1:
            first = r["page_id"] == largest[h]
            assert (r["record_type"], r["refers_to"]) == (("response", None) if first else ("revisit", largest[h]))


def test_knn(spark, tmp_path):
    """Nulls, ties, repeated vectors and fewer candidates than five."""
    r = random.Random(4)
    rows = [(i, [r.choice((-1.0, 0.0, 0.5, r.random())) for _ in range(8)], 1) for i in range(0, 260)] + [(300, None, 1), (350, [0.5] * 7 + [None], 1), (400, [float("nan")] * 8, 1)]
    rows += [(1000 + i, rows[50][1], 2) for i in range(7)]
    for n, table in ((len(rows), rows), (3, rows[:3])):
        path = tmp_path / str(n)
        spark.createDataFrame([(*x, "clash", 1) for x in table], "vec_id long, embedding array<float>, label int, id string, cell int").repartition(3).write.parquet(str(path / "embeddings.parquet"))
        kept = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v, _ in table if v is not None and all(c is not None and math.isfinite(c) for c in v)}
        want = set()
        for i in (k for k in kept if k % 50 == 0):
            best = sorted((-sum(a * b for a, b in zip(kept[i], kept[j])), j) for j in kept if j != i)[:5]
            want |= {(i, rank, j, -s) for rank, (s, j) in enumerate(best, 1)}
        assert {tuple(x)[:4] for x in queries.op8_knn_join(spark, str(path)).select("query_id", "rank", "vec_id", "score").collect()} == want
