import time
import base64
import hashlib
import zipfile
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute, fixtures
from tidemark.llm import bpe, common, knn_join, language_id, line_rules, ngram_join, pfair_mix, pii, quality_pu, queries, secrets, warc_zip

ROWS = fixtures.documents()
TEXT = {r[0]: r[1] for r in ROWS}


@pytest.fixture(scope="module")
def docs(spark):
    return fixtures.frame(spark).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return fixtures.frame(spark, []).where("false")


def test_personal_data(docs, empty):
    found = pii.personal_spans(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in ROWS)
    for r in found:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert spans == brute.pii_base(TEXT[r["doc_id"]])
    assert any(r["spans"] for r in found)
    assert pii.personal_spans(empty).collect() == []


def test_personal_data_in_hard_texts(spark):
    hard = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.2.3.4", "a@" + "b." * 30_000 + "c", "+1" + "(" * 30_000, "1 " * 30_000, "4111-1111 1111-1111-", "+12345678 +1234567", "é😀a@b.c", "a@@b.c @d.e x@y"]
    found = pii.personal_spans(spark.createDataFrame(list(enumerate(hard)), "doc_id long, text string")).collect()
    for r in found:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == brute.pii_base(hard[r["doc_id"]])


def test_personal_data_in_hostile_texts(spark):
    """A hundred thousand repeats of each pattern's loop, and of its matches: no stack runs out and nothing is quadratic. (The plain restatement is quadratic, so it is held against short ones.)"""

    def texts(n: int, m: int) -> list[str]:
        loops = ["a@b" + ".c" * n, "1" + ".1" * n, "1" + "-1" * n, "+1" + " 1" * n, "555" + "-123" * n, "123-45" * n, "DE12 " + "ABCD " * n, "x[at]y" + ".z" * n, "x[at]y" + " [dot] z" * n, "Mr. James" + " Smith" * n, "Mr " * n, "(" * n]
        return loops + [x * m for x in ("a.b@mail.example.com ", "1.2.3.4 ", "4111 1111 1111 1111 x ", "+1 (555) 123-4567 x ", "555-123-1234 ", "123-45-6789 ", "James Smith a@b.c ", "x [at] y.z a@b.c ")]

    for n, m in ((700, 200), (100_000, 20_000)):
        rows = texts(n, m)
        found = {r["doc_id"]: r["spans"] for r in pii.candidates(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()}
        for i, text in enumerate(rows if n < 1000 else []):
            assert [(pii.NAMES[s["kind"]], s["start"], s["end"]) for s in found[i] if s["kind"] < 4] == brute.pii_base(text)
        assert [len(found[i]) for i in range(12, 20)] == [m] * 6 + [2 * m] * 2
        assert [(s["start"], s["end"]) for s in found[7]] == [(0, len(rows[7]))]


def test_added_spans_apart_from_base_spans(spark):
    """The merge of two sorted lists against all pairs."""
    import random

    r = random.Random(17)
    span = lambda kind: (kind, a := r.randrange(400), a + r.randrange(1, 12), "m", "b")
    rows = [(i, [span(1) for _ in range(r.randrange(60))], [span(6) for _ in range(r.randrange(300))]) for i in range(60)]
    kind = "array<struct<kind:int,start:bigint,end:bigint,match:string,before:string>>"
    df = spark.createDataFrame(rows, f"i long, base {kind}, added {kind}")
    got = {x["i"]: sorted(map(tuple, x["kept"])) for x in df.select("i", pii.apart(F.col("added"), F.col("base")).alias("kept")).collect()}
    for i, base, added in rows:
        assert got[i] == sorted(a for a in added if not any(a[1] < b[2] and b[1] < a[2] for b in base))


def test_added_personal_spans(spark):
    """Local numbers after a word of contact are found; numbers after order words are not, once both are seen often enough."""
    rows = [(i, f"Please call me (555) 123-{1000 + i} today. ") for i in range(60)] + [(100 + i, f"See invoice 555-123-{1000 + i} here. ") for i in range(60)]
    rows += [(200 + i, f"Mail a{i}@mail.example.com and phone +1 (555) 222-{1000 + i}.") for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(any(s["kind"] == "tel" for s in found[i]) for i in range(60))


def test_no_python_in_the_plan_of_personal_data(docs):
    plan = pii.personal_spans(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_secrets(docs, empty):
    found = secrets.secret_spans(docs).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(r[0] for r in ROWS)
    for r in found:
        text = TEXT[r["doc_id"]] or ""
        base = [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]]
        assert base == brute.secrets_base(text)
        for s in r["spans"]:
            assert s["base"] or (s["score"] >= 1 and len(text[s["start"] : s["end"]]) >= 16)
    assert secrets.secret_spans(empty).collect() == []


def test_random_strings_and_identifiers(spark):
    random_, plain = secrets.generated(60, seed=99), ["getUserAccountBalance2", "internationalization18n", "very-long-hyphenated-name-1", "background_image_width2"]
    words = "get user account balance international hyphenated very long name background image width colour table index value total amount".split()
    rows = [(i, " ".join(words[(i + k) % len(words)] for k in range(200))) for i in range(50)] + [(1000 + i, f"see {t} here") for i, t in enumerate(random_)] + [(2000 + i, f"see {t} here") for i, t in enumerate(plain)]
    hit = {r["doc_id"] for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["spans"]}
    eligible = [1000 + i for i, t in enumerate(random_) if any(c.isdigit() for c in t) and any(c.isalpha() for c in t)]
    assert sum(i in hit for i in eligible) >= 0.9 * len(eligible)
    assert not any(i >= 2000 for i in hit)


def test_redaction(docs):
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    for r in clean.collect():
        assert not brute.secrets_base(r["text"]) if r["text"] else r["text"] == TEXT[r["doc_id"]]


def test_language(spark, docs, empty):
    held = queries.fold(3) == 1
    found = {r["doc_id"]: r for r in language_id.identify(docs, learn_from=queries.fold(3) != 1).withColumn("held", held).collect()}
    wrong = [r[0] for r in ROWS if r[1] and r[2] and any(c.isalpha() for c in r[1]) and len(r[1]) > 100 and r[0] is not None and r[0] < 120 and found[r[0]]["lang_pred"] != r[2]]
    assert len(wrong) <= 1
    for r in ROWS:
        letters = any(c.isalpha() for c in r[1] or "")
        assert (found[r[0]]["lang_pred"] == "und") == (not letters) and 0 <= found[r[0]]["score"] <= 1
    assert language_id.identify(empty).collect() == []
    assert {r["lang_pred"] for r in language_id.identify(docs, learn_from=F.lit(False)).collect()} == {"und"}


def test_mixed_language_spans(spark, docs):
    text = fixtures.text_of(__import__("random").Random(4), "en", 60) + " " + fixtures.text_of(__import__("random").Random(5), "ru", 60) + " " + fixtures.text_of(__import__("random").Random(6), "de", 60)
    row = language_id.identify(docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(999, text, None)], "doc_id long, text string, lang string"))).where("doc_id = 999").first()
    assert [s["lang"] for s in row["spans"]] == ["en", "ru", "de"]


def plain_words(text):
    """The words of a text, as lists of (trigram bucket, script)."""
    low = [c.lower() if len(c.lower()) == 1 else c for c in text]
    script = [language_id.NAMES.index([n for a, n in language_id.SCRIPTS if a <= ord(c)][-1]) if c.isalpha() else -1 for c in low]
    words = []
    for i, c in enumerate(low):
        if script[i] < 0:
            continue
        new = i == 0 or script[i - 1] != script[i]
        prev = 0 if new else ord(low[i - 1])
        nxt = ord(low[i + 1]) if i + 1 < len(low) and script[i + 1] == script[i] else 0
        key = np.array([prev << 42 | ord(c) << 21 | nxt], np.uint64)
        if new:
            words.append([])
        words[-1].append((int(common.mix(key)[0]) >> 48, script[i]))
    return words


def plain_languages(train, texts, penalty=15.0):
    """(language, score) of each text: counts in dictionaries and every step of the path search."""
    langs = sorted({lang for _, lang in train})
    counts, scripts = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for text, lang in train:
        for w in plain_words(text):
            counts[lang].update(b for b, _ in w)
            scripts[lang].update(s for _, s in w)
    total = {x: sum(counts[x].values()) for x in langs}
    allowed = {s: [x for x in langs if scripts[x][s] / max(total[x], 1) >= 0.005] or langs for s in range(len(language_id.NAMES))}
    out = []
    for text in texts:
        words = plain_words(text)
        if not words:
            out.append(("und", 0.0))
            continue
        rows = [[sum(np.log((counts[x][b] + 0.05) / (total[x] + 0.05 * language_id.BUCKETS)) - 25 * (x not in allowed[s]) for b, s in w) for x in langs] for w in words]
        state, back = list(rows[0]), []
        for row in rows[1:]:
            k = state.index(max(state))
            step = [i if state[i] >= state[k] - penalty else k for i in range(len(langs))]
            state = [max(state[i], state[k] - penalty) + row[i] for i in range(len(langs))]
            back.append(step)
        path = [state.index(max(state))]
        for step in reversed(back):
            path.append(step[path[-1]])
        held = Counter()
        for w, k in zip(words, reversed(path), strict=True):
            held[k] += len(w)
        best = min(held, key=lambda k: (-held[k], k))
        sums = [sum(r[k] for r in rows) for k in range(len(langs))]
        out.append((langs[best], held[best] / sum(held.values()) / sum(np.exp(min(x - sums[best], 700)) for x in sums)))
    return out


def test_languages_against_a_plain_restatement(spark):
    mixed = fixtures.text_of(__import__("random").Random(1), "en", 30) + " " + fixtures.text_of(__import__("random").Random(2), "ru", 30)
    rows = [*ROWS, (5001, mixed, None), (5002, "ΟΔΟΣ ἀγορά", None), (5003, "İstanbul and ΟΔΟΣ", None), (5004, "漢字 かな 한국어", None)]
    rows = [(r[0], r[1], r[2]) for r in rows if r[0] is not None]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learn_from=queries.fold(3) != 1).collect()
    train = [(t, lang) for i, t, lang in rows if t is not None and lang is not None and __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    want = sorted((i, *x) for (i, _, _), x in zip(rows, plain_languages(train, [t or "" for _, t, _ in rows]), strict=True))
    got = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in found)
    assert [x[:2] for x in got] == [x[:2] for x in want]
    assert [x[2] for x in got] == pytest.approx([x[2] for x in want], rel=1e-3, abs=1e-6)


def test_viterbi_shortcut_is_exact():
    r = np.random.default_rng(3)
    for _ in range(200):
        scores, penalty = r.normal(0, 1, (12, 3)), 2.0
        path = language_id.viterbi(scores, penalty)
        value = lambda p: sum(scores[t, k] for t, k in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
        best = scores[0]
        for row in scores[1:]:
            best = np.maximum(best, best.max() - penalty) + row
        assert value(list(path)) == pytest.approx(best.max())


def test_archives(spark):
    rows = [(i, f"https://a.example/{i}", "x" * (i % 7) + "é") for i in range(40)] + [(40, None, None), (41, "u", ""), (42, "u", "y" * 300_000), (None, "u", "zz"), (None, "u", "x" + "é"), (42, "u", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, sha string").repartition(3)
    joined = [warc_zip.with_originals(pages, broadcast_digests=n).collect() for n in (1000, 0)]
    assert Counter(map(tuple, joined[0])) == Counter(map(tuple, joined[1]))
    for zip64 in (False, True):
        archives = warc_zip.write_archives(pages, common.work_path(spark, "warc"), zip64=zip64)
        for a in archives.collect():
            with zipfile.ZipFile(a["path"].removeprefix("file:")) as z:
                assert z.testzip() is None and all(i.compress_type == 0 for i in z.infolist())
        back = warc_zip.read_records(warc_zip.locate_records(archives)).collect()
        largest = {}
        for i, _, h in rows:
            largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
        expected = Counter()
        for i, _, h in rows:
            p, top = (h or "").encode(), largest[h or ""]
            revisit = top >= 0 and top != i
            expected[i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", top if revisit else None, None if revisit else p] += 1
        assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in back) == expected
    assert warc_zip.archive_and_read(spark, pages.where("false"), common.work_path(spark, "warc")).collect() == []


def test_damaged_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc_zip.DATA, "abc" * 100)
    with open(tmp_path / "x.zip", "rb") as f, pytest.raises(ValueError, match="compressed as a whole"):
        warc_zip.located(f, (tmp_path / "x.zip").stat().st_size, warc_zip.DATA)


def test_bpe(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    both = bpe.decode(bpe.encode(docs, path), path).collect()
    assert Counter(r["doc_id"] for r in both) == Counter(r[0] for r in ROWS)
    for r in both:
        ids = library.encode(TEXT[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert sorted(map(str, bpe.encode(docs, path, decoded=True).collect())) == sorted(map(str, both))
    assert bpe.encode(empty, path).collect() == []


def test_bpe_on_random_strings():
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, r = Tokenizer.from_file(path), bpe.Vocabulary(path), random.Random(8)
    alphabets = ("abcdefghij", "the'sldm 012!?.-_", "éèßÄ Σςİ", "漢字かな한국 عرب", "́̈e \x1c\x1d\x85\xa0​\x0b", "😀👍½²Ⅷ௧ǅ")
    for _ in range(4000):
        s = "".join(r.choice(r.choice(alphabets)) for _ in range(r.randrange(30)))
        assert own.encode(s).tolist() == library.encode(s, add_special_tokens=False).ids
    assert own.encode("a" * 20_000).tolist() == library.encode("a" * 20_000, add_special_tokens=False).ids


def test_bpe_on_all_code_points():
    """Each code point of the planes that have any, alone, within a word, and as a mark beside marks."""
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    library, own, r = Tokenizer.from_file(path), bpe.Vocabulary(path), random.Random(9)
    points = [chr(p) for p in (*range(0xD800), *range(0xE000, 0xE100), *range(0xF900, 0x11200), *range(0x11200, 0x1FC00), *range(0x323A0, 0x33500, 7), *range(0xE0000, 0xE01F0, 5))]
    texts = [f"{c} a{c}b 1{c}{c} '{c}s\u0301{c}\u0323 !{c}" for c in points]
    texts += ["".join(r.choice(points) if r.random() < 0.5 else r.choice("ab'st 1!\u0301") for _ in range(12)) for _ in range(20_000)]
    for text, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert own.encode(text).tolist() == want.ids, ascii(text)


WEIGHTS = [{"a": 1}, {"a": 5, "b": 3, "c": 2}, {"a": 500, **{f"s{i}": 10 for i in range(50)}}, {"a": 7, "b": 7}, {"x": 997, "y": 2, "z": 1}]


def target(parts, t):
    """What the target has sent of each source at slot t, by a walk from one source's end to the next."""
    sent, at = dict.fromkeys(parts, Fraction(0)), Fraction(0)
    while at < t:
        going = {s: w for s, (w, n) in parts.items() if sent[s] < n}
        step = min([t - at] + [(parts[s][1] - sent[s]) * sum(going.values()) / w for s, w in going.items()])
        for s, w in going.items():
            sent[s] += step * w / sum(going.values())
        at += step
    return sent


@pytest.mark.parametrize("weights", WEIGHTS)
@pytest.mark.parametrize("run_out", [False, True])
def test_schedule_deviates_by_less_than_a_block(weights, run_out):
    """While all sources last, and when some run out within the frame, one after the other."""
    parts = {s: (w, max(1, w * (i % 7 + 1) // 7) if run_out else w) for i, (s, w) in enumerate(weights.items())}
    seen, slots = Counter(), pfair_mix.schedule(parts)
    for t, (source, k) in enumerate(slots, 1):
        assert k == seen[source]
        seen[source] += 1
        assert all(abs(seen[s] - x) < 1 for s, x in target(parts, t).items())
    assert seen == Counter({s: n for s, (_, n) in parts.items()})


def test_schedule_of_many_random_parts():
    import random

    r = random.Random(12)
    for _ in range(300):
        weights = {f"s{i}": r.randrange(1, 40) for i in range(r.randrange(1, 9))}
        parts = {s: (w, r.randrange(1, w + 1)) for s, w in weights.items()}
        seen = Counter()
        for t, (source, _) in enumerate(pfair_mix.schedule(parts), 1):
            seen[source] += 1
            assert all(abs(seen[s] - x) < 1 for s, x in target(parts, t).items())


def test_mix(spark, docs, empty):
    weights = {"s0": 5, "s1": 2, "s2": 2, "s3": 1, "s4": 0}
    found = pfair_mix.mix(docs, weights, block_chars=400, min_live=0.5, ranges=4).collect()
    assert len(found) == len(ROWS)
    assert all((r["slot"] is None) == (r["source"] in ("s4", "")) for r in found)
    slots = {(r["source"], r["block"]): r["slot"] for r in found if r["slot"] is not None}
    assert sorted(slots.values()) == list(range(len(slots)))
    order = [s for (s, _), _ in sorted(slots.items(), key=lambda x: x[1])]
    live_until = min(max(t for t, s in enumerate(order) if s == name) for name in ("s0", "s1", "s2", "s3"))
    blocks, seen = Counter(order), Counter()
    whole = min(blocks[s] // weights[s] for s in blocks) * 10
    for t, s in enumerate(order[:whole], 1):
        seen[s] += 1
        assert all(abs(seen[x] * 10 - t * weights[x]) < 10 for x in blocks)
    assert live_until >= whole - 10
    # The brute force: simulate frame by frame.
    expected, f = [], 0
    while any(n > f * weights[s] for s, n in blocks.items()):
        expected += [s for s, _ in pfair_mix.schedule({s: (weights[s], min(weights[s], n - f * weights[s])) for s, n in blocks.items() if n > f * weights[s]})]
        f += 1
    assert order == expected
    # On target all along, also where sources have run out; and the mix ends when less than half of the weight is left.
    seen = Counter()
    for t, s in enumerate(order, 1):
        seen[s] += 1
        assert all(abs(seen[x] - y) < 1 for x, y in target({s: (weights[s], n) for s, n in blocks.items()}, t).items())
    ends = {s: Fraction(n, weights[s]) for s, n in blocks.items()}
    last = min(e for e in ends.values() if sum(weights[s] for s in ends if ends[s] > e) < 5)
    assert all(r["in_mix"] == (r["slot"] is not None and Fraction(r["block"], weights[r["source"]]) < last) for r in found)
    assert pfair_mix.mix(empty, weights).collect() == [] and pfair_mix.mix(empty).collect() == []


def test_mixed_keeps_rows(docs):
    out = pfair_mix.mixed(docs, block_chars=400, min_live=0.01, ranges=4)
    assert out.columns == docs.columns
    assert Counter(r["doc_id"] for r in out.collect()) <= Counter(r[0] for r in ROWS)


def test_line_rules(docs, empty):
    found = line_rules.clean_lines(docs).collect()
    assert len(found) == len(ROWS)
    for r in found:
        text = TEXT[r["doc_id"]] or ""
        w = brute.words(text)
        windows = Counter(zip(w, w[1:], w[2:]))
        again = {i + j for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if brute.words(x)]
        failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and r["kept"]) and (failed or r["kept"] == (r["lost"] <= 0.4))
    assert line_rules.clean_lines(empty).collect() == []


def test_line_verdicts():
    assert line_rules.line_fails("Home | News | About | Contact") == "navigation"
    assert line_rules.line_fails("All rights reserved.") == "boilerplate"
    assert line_rules.line_fails("w### of*** the$$$ it%%%") == "symbols"
    assert line_rules.line_fails("a line without any end mark here") == "punctuation"
    assert line_rules.line_fails("A plain sentence of a text, with an end.") == "" == line_rules.line_fails("  ")


def test_knn_join(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 8).astype(np.float32)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(60)]  # ties
    rows += [(500, None), (550, []), (600, [float("nan")] * 8), (650, [float("inf")] * 8), (700, [None] * 8), (None, rows[0][1]), (750, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, cell string").repartition(4)
    fine = {i: np.pad(np.floor(256 * np.array(v, float)), (0, 8 - len(v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q in (i for i in fine if i % 50 == 0):
        scores = sorted(((-int(fine[q] @ fine[x]), x) for x in fine if x != q))[:5]
        expected += [(q, k, x, -s) for k, (s, x) in enumerate(scores, 1)]
    for size, block, part in ((2048, 4_000_000, 8192), (20, 400, 3)):
        got = knn_join.knn_join(df, F.col("id") % 50 == 0, cell_rows=size, block_values=block, part_queries=part).collect()
        assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(expected)
    few = df.where("vec_id in (0, 7)")
    assert len(knn_join.knn_join(few, F.col("id") % 50 == 0).collect()) == 1
    assert knn_join.knn_join(df.where("false"), F.col("id") % 50 == 0).collect() == []


def test_quality(spark):
    import random

    r, rows, labels = random.Random(2), [], []
    for i in range(600):
        good = r.random() < 0.7
        text = fixtures.text_of(r, "en", r.randrange(60, 200))
        rows.append((i, text if good else " | ".join(w + r.choice(["###", "$$$", "%%%"]) for w in text.split()), "clash"))
        if i % 2:
            labels.append((i, int(good)))
    rows += [(1000, None, ""), (1001, "", ""), (1002, "x " * 20_000, ""), (7, rows[7][1], "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (9999, None)], "doc_id long, quality int")
    found = quality_pu.score_quality(docs, marks, learn_from=queries.fold(5) != 0).withColumn("held", queries.fold(5) == 0).collect()
    assert len(found) == len(rows)
    truth = dict(labels)
    held = [x for x in found if x["held"] and x["doc_id"] in truth]
    assert sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.9 * len(held)
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in found)
    assert {x["score"] for x in quality_pu.score_quality(docs, marks.where("false")).collect()} == {0.5}
    assert quality_pu.score_quality(docs.where("false"), marks).collect() == []
    again = quality_pu.score_quality(docs.repartition(5, "text"), marks.repartition(3), learn_from=queries.fold(5) != 0).collect()
    assert Counter((x["doc_id"], x["score"]) for x in again) == Counter((x["doc_id"], x["score"]) for x in found)


@pytest.mark.parametrize("prior", [None, 0.3, 0.95])
def test_risk_against_its_differences(prior):
    """Steps along plain differences of the risk, one weight at a time, give the weights of the fit; a negative part turns them round."""
    r = np.random.default_rng(4)
    good, web = r.normal(1, 1, (40, 2)), r.normal(0, 1, (60, 2))
    fitted = quality_pu.Classifier(np.concatenate((good, web)), bins=4)
    p, u, w, turned = fitted.cells(good), fitted.cells(web), np.zeros_like(fitted.weights), 0
    loss = lambda z, label: np.log1p(np.exp(-z if label else z)).mean()

    def parts(w):
        zp, zu = w[p].sum(1) + w[-1], w[u].sum(1) + w[-1]
        return (loss(zp, 1), loss(zu, 0)) if prior is None else (prior * loss(zp, 1), loss(zu, 0) - prior * loss(zp, 0))

    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, 61):
        good_part, rest = parts(w)
        own = (lambda x: sum(parts(x))) if rest >= 0 or prior is None else (lambda x: -parts(x)[1])
        turned += prior is not None and rest < 0
        g = np.array([(own(w + e) - own(w - e)) / 2e-5 for e in 1e-5 * np.eye(len(w))]) + 0.00001 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert fitted.fit(good, web, prior, steps=60).weights == pytest.approx(w, abs=0.02)
    assert (turned > 0) == (prior is not None)


def test_class_prior():
    r = np.random.default_rng(0)
    p, n = r.beta(8, 2, 4000), r.beta(2, 8, 4000)
    assert abs(quality_pu.class_prior(p[:2000], np.concatenate((p[2000:], n[:1000]))) - 2 / 3) < 0.06


def jaccard_classes(rows, k, threshold):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for i, text in rows:
        w = brute.words((text or "").translate(lower))
        sets.append((i, frozenset(zip(*(w[j:] for j in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])))
    label = list(range(len(sets)))

    def find(a):
        while label[a] != a:
            a = label[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                label[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return Counter((i, len(s), least.get(find(a)) if s else i) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize("k, threshold", [(4, 85), (5, 80), (2, 60)])
def test_ngram_join(spark, docs, empty, k, threshold):
    got = Counter(map(tuple, ngram_join.jaccard_join(docs, k, threshold).collect()))
    assert got == jaccard_classes([(r[0], r[1]) for r in ROWS], k, threshold)
    if k == 4:
        assert ngram_join.jaccard_join(empty, k, threshold).collect() == []


def test_ngram_join_of_chains_and_short_texts(spark):
    import random

    r = random.Random(11)
    rows, words = [], [f"w{i}" for i in range(60)]
    for i in range(60):  # a chain: each differs a little from the one before, the ends have little in common
        words = words[:]
        words[(i * 7) % 60] = f"n{i}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + i, " ".join(r.choice("abc") for _ in range(r.randrange(1, 14)))) for i in range(250)]
    got = Counter(map(tuple, ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()))
    assert got == jaccard_classes(rows, 4, 85)


def test_blocks_of_a_cluster_agree(spark):
    """Small blocks: a cluster that is dealt out in many gives the same links."""
    import random

    r = random.Random(12)
    base = fixtures.text_of(r, "en", 120)
    rows = [(i, fixtures.near(r, base, r.randrange(10))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members = ngram_join.buckets(ngram_join.signed(df, 4, 85))
    classes = ngram_join.sets(df, 4).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"))
    shingles = ngram_join.shingles_of(df, classes, 4, "doc_id", "text")
    clustered = ngram_join.clusters(members)
    parts = [ngram_join.components(ngram_join.links_in_clusters(clustered, shingles, classes, 85, block_sets=n)) for n in (1000, 7)]
    assert sorted(map(tuple, parts[0].collect())) == sorted(map(tuple, parts[1].collect()))


def test_open_buckets_agree_as_pairs_and_in_blocks(spark):
    """Without any cluster all links are found across: as pairs or in blocks, they give the same components."""
    import random

    r = random.Random(13)
    rows = [(100 * b + i, fixtures.near(r, base, r.randrange(10))) for b in range(3) for base in (fixtures.text_of(r, "en", 120),) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members = ngram_join.buckets(ngram_join.signed(df, 4, 85))
    classes = ngram_join.sets(df, 4).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"))
    shingles = ngram_join.shingles_of(df, classes, 4, "doc_id", "text")
    alone = members.select("node", F.col("node").alias("cluster")).distinct()
    want = sorted(map(tuple, ngram_join.linked_components(members, shingles, classes, ngram_join.clusters(members), 85).collect()))
    assert want
    for paired in (0, 5, 1000):
        assert sorted(map(tuple, ngram_join.linked_components(members, shingles, classes, alone, 85, paired).collect())) == want


def test_parameters_of_the_join_change_nothing(spark, docs):
    """Buckets passed on unseen, signatures over keys of their own, blocks instead of pairs, enumeration in all bands, ids that aren't broadcast."""
    want = Counter(map(tuple, ngram_join.jaccard_join(docs, 4, 85).collect()))
    for other in ({"sketched": 2, "hot": 2, "broadcast_ids": 0}, {"paired": 0, "enumerated": 10**6, "hot": 3}):
        assert Counter(map(tuple, ngram_join.jaccard_join(docs, 4, 85, **other).collect())) == want


def test_repeated_rows_are_one_set(spark):
    """Thousands of rows of one id, and a near copy: one set each."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text)] * 5000 + [(9, text + " end"), (8, "other words of another text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    shingles = ngram_join.shingles_of(df, df.select("doc_id").distinct(), 4, "doc_id", "text")
    assert shingles.count() == 3
    got = ngram_join.jaccard_join(df, 4, 85).groupBy("doc_id", "component_id").count().collect()
    assert {tuple(r) for r in got} == {(7, 7, 5000), (9, 7, 1), (8, 8, 1)}


@pytest.mark.parametrize("most", [True, False])
def test_members_that_the_centre_misses(spark, most):
    """Most or few of a cluster aren't linked to its centre: links among the others are found in blocks."""
    r = np.random.default_rng(3)
    pool = np.unique(r.integers(-(2**62), 2**62, 6000))
    r.shuffle(pool)
    core, sets_ = pool[:100], {}
    for i in range(30):  # copies of the core; pairs with each other far from it
        sets_[i] = np.concatenate((core, pool[100 + 2 * i : 102 + 2 * i]))
    for i in range(30, 130 if most else 40):
        own = pool[1000 + (i // 2) * 60 : 1060 + (i // 2) * 60]
        sets_[i] = own if i % 2 else own[:-3]
    shingles = spark.createDataFrame([(i, np.sort(s).tolist()) for i, s in sets_.items()], "node long, shingles array<long>")
    sizes = shingles.select("node", F.size("shingles").alias("n_shingles"))
    clustered = shingles.select("node", F.lit(0).cast("long").alias("cluster"))
    want = {}
    for i in sets_:
        want[i] = min(j for j in sets_ if 100 * len(np.intersect1d(sets_[i], sets_[j])) >= 85 * len(np.union1d(sets_[i], sets_[j])))
    for n in (1000, 7):
        got = {x["node"]: x["root"] for x in ngram_join.components(ngram_join.links_in_clusters(clustered, shingles, sizes, 85, block_sets=n)).collect()}
        assert {i: got.get(i, i) for i in sets_} == want


@pytest.mark.parametrize("threshold", [80, 85])
def test_signatures_meet(threshold):
    """Sets that are just similar enough share a signature, whatever their sizes."""
    r, bands = np.random.default_rng(5), ngram_join.Bands(threshold)
    for _ in range(1500):
        n = int(r.integers(1, 400))
        pool = np.unique(r.integers(0, 2**64, 2 * n + 2, np.uint64))
        r.shuffle(pool)
        one, drop = pool[:n], int(r.integers(0, n + 1))
        for add in range(n + 1):  # the most that may be added besides
            if 100 * (n - drop) < threshold * (n + add):
                break
        else:
            add = n + 1
        if not add:
            continue
        two = np.concatenate((one[drop:], pool[n : n + add - 1]))
        if drop + add == 1:
            continue  # equal
        assert len(np.intersect1d(ngram_join.signatures(np.sort(one), bands), ngram_join.signatures(np.sort(two), bands)))


@pytest.mark.parametrize("copies", [2, 6])
def test_knn_join_of_a_repeated_query(spark, copies):
    """Rows with the query's id are no candidates, and don't stand for others in the bound either."""
    r = np.random.default_rng(5)
    rows = [(50, [1.0, 0.5])] * copies + [(i, [float(x) for x in r.normal(0, 0.2, 2)]) for i in range(1, 40)] + [(7, [0.4, 0.4])] * 8
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    fine = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows]
    want = sorted((-int(fine[0][1] @ v), i) for i, v in fine if i != 50)[:5]
    for block in (4_000_000, 10):
        got = knn_join.knn_join(df, F.col("id") == 50, cell_rows=8, block_values=block).collect()
        assert sorted((x["rank"], x["vec_id"], x["score"]) for x in got) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]
    far = spark.createDataFrame([x for x in rows if x[0] != 7], df.schema).repartition(3)
    want = sorted((-int(fine[0][1] @ v), i) for i, v in fine if i not in (50, 7))[:5]
    got = knn_join.knn_join(far, F.col("id") == 50).collect()
    assert sorted((x["rank"], x["vec_id"], x["score"]) for x in got) == [(k, i, -s) for k, (s, i) in enumerate(want, 1)]


def test_knn_join_of_huge_components(spark):
    """Beyond the range of squares and of longs: such rows lose to none by overflow, and scores are held to a long."""
    r = np.random.default_rng(9)
    rows = [(i, [float(x) for x in r.normal(0, 1, 4)]) for i in range(120)]
    rows += [(200, [1e160, 1.0, 0.0, 0.0]), (250, [-1e300, 0.0, 1.0, 0.0]), (201, [1e300, 0.0, 0.0, 0.0]), (202, [1.7e308, 0.0, 0.0, 0.0]), (203, [float(1 << 45), 1.0, 0.0, 0.0]), (204, [3e6, -3e6, 1.0, 0.5])]
    import math

    whole = {i: [math.floor(x * 256) if abs(x * 256) < 9e15 else int(max(min(x * 256, 1.7e308), -1.7e308)) for x in v] for i, v in rows}
    want = []
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))), i) for i in whole if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for size in (8, 2048):
        got = knn_join.knn_join(df, F.col("id") % 50 == 0, cell_rows=size).collect()
        assert sorted((x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in got) == sorted(want)


def test_knn_join_prunes(spark):
    """Tight clusters: queries meet few cells, and the result is that of brute force."""
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (12, 16))
    x = np.floor(256 * (centres[np.arange(1200) % 12] + r.normal(0, 0.02, (1200, 16))))
    df = spark.createDataFrame([(i, (v / 256).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = knn_join.knn_join(df, F.col("id") % 50 == 0, cell_rows=40)
    want = []
    for q in range(0, 1200, 50):
        scores = sorted((-int(x[q] @ x[i]), i) for i in range(1200) if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    assert sorted((y["query_id"], y["rank"], y["vec_id"], y["score"]) for y in got.collect()) == sorted(want)
    pivots = knn_join.Pivots(x[:30])
    data = knn_join.assigned(knn_join.valid(df, "vec_id", "embedding", 256.0), pivots, 16).cache()
    cells = knn_join.summaries(data)
    queries = knn_join.bounded_queries(data.where("id % 50 = 0").select("id", "v"), pivots, cells, (np.arange(1200), x), 5, 16)
    assert queries.agg(F.avg(F.size("cells"))).first()[0] <= 0.35 * len(cells)


def test_random_strings_without_digits_and_beside_others(spark):
    """Letters alone, a second secret after a base span, and one after an ordinary name are found; long ordinary words are not."""
    import random
    import string

    r = random.Random(31)
    pick = lambda n, alphabet: "".join(r.choices(alphabet, k=n))
    words = "get user account balance international hyphenated very long name background image width colour table index value total amount".split()
    rows = [(i, " ".join(words[(i + k) % len(words)] for k in range(200))) for i in range(50)]
    letters = [pick(32, string.ascii_letters) for _ in range(40)]
    base62 = [pick(32, string.ascii_letters + string.digits) for _ in range(40)]
    hard = [(f"see {t} here", t) for t in letters] + [(f"see x/{pick(24, '0123456789abcdef')}/{t} here", t) for t in base62] + [(f"see very_long_background_image_name_of_account={t} here", t) for t in base62]
    rows += [(1000 + i, text) for i, (text, _) in enumerate(hard)]
    plain = ["internationalizationvalue", "very_long_hyphenated_background_image", "getUserAccountBalanceTotal", "z" * 40, "-" * 40]
    rows += [(2000 + i, f"see {t} here") for i, t in enumerate(plain)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x["doc_id"]: x["spans"] for x in secrets.secret_spans(docs).collect()}
    clean = {x["doc_id"]: x["text"] for x in secrets.redact(docs).collect()}
    for part in range(3):
        own = range(40 * part, 40 * part + 40)
        assert sum(any(s["kind"] == "random" and hard[i][0][s["start"] : s["end"]].endswith(hard[i][1]) for s in found[1000 + i]) and hard[i][1] not in clean[1000 + i] for i in own) >= 36
    assert not any(found[2000 + i] for i in range(len(plain)))


def test_mix_of_many_sources(spark):
    """20,000 sources with one to four blocks, one with thousands: the plan keeps a row a source, slots have no gaps, and how sources are dealt over ranges changes nothing."""
    n = F.col("id")
    small = spark.range(50_000).select(n.alias("doc_id"), F.concat(F.lit("s"), n % 20_000).alias("source"), F.repeat(F.lit("x"), (5 + n % 7).cast("int")).alias("text"))
    docs = small.unionByName(spark.range(30_000).select((n + 50_000).alias("doc_id"), F.lit("large").alias("source"), F.lit("x" * 9).alias("text")))
    began = time.time()
    got = pfair_mix.mix(docs, block_chars=10, total_weight=30_000).select("doc_id", "source", "block", "slot").toPandas()
    assert len(got) == 80_000 and got["slot"].notna().all() and time.time() - began < 90
    slots = got.drop_duplicates(["source", "block"])["slot"]
    assert sorted(slots) == list(range(len(slots)))
    again = pfair_mix.mix(docs, block_chars=10, total_weight=30_000, ranges=16).select("doc_id", "slot").toPandas()
    assert dict(zip(again["doc_id"], again["slot"])) == dict(zip(got["doc_id"], got["slot"]))


def named_texts():
    given, family = ("Anna", "Klaus", "Pierre", "Carmen", "Mary"), ("Okafor", "Weber", "Dupont", "Vega", "Stone")
    rows = []
    for i in range(50):
        a, b = given[i % 5], family[i // 5 % 5]
        rows += [(len(rows), f"the letter was signed by {a} {b} and sent to Dr. {b} that day"), (len(rows) + 1, f"Oure Oure was read. General Public rules apply{i}. Der Hund lief. invoice {a}"), (len(rows) + 2, f"Mail a{i}@mail.example.com, or call (555) 123-{1000 + i}; see invoice 555-123-{1000 + i}.")]
    return rows


def test_em_and_classifier_restated(spark):
    """Priors, reliabilities and scores against plain loops over the same votes; planted names are found, capitals at the start of sentences and doubled words aren't."""
    import math

    rows = named_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = common.saved(pii.candidates(docs).withColumn("row", F.monotonically_increasing_id()), "t-candidates")
    names = spark.createDataFrame([(n,) for n in pii.GIVEN_NAMES], "name string")
    spans = common.saved(pii.described(found, names), "t-described")
    weights, model = pii.train(spans)
    each = [s for r in spans.collect() for s in r["spans"]]
    kinds = range(pii.LABELERS)
    prior, yes, no = 0.5, [[0.3, 0.6, 0.1]] * pii.LABELERS, [[0.3, 0.1, 0.6]] * pii.LABELERS

    def chance(votes):
        a, b = prior, 1 - prior
        for j in kinds:
            a, b = a * yes[j][votes[j]], b * no[j][votes[j]]
        return a / (a + b)

    for _ in range(30):
        y = [chance(s["votes"]) for s in each]
        table = lambda p: [[(sum(q for q, s in zip(p, each) if s["votes"][j] == v) + 1) / (sum(p) + 3) for v in range(3)] for j in kinds]  # noqa: E731, B023
        prior, yes, no = (sum(y) + 1) / (len(y) + 2), table(y), table([1 - q for q in y])
    assert model["prior"] == pytest.approx(prior) and np.allclose(model["yes"], yes) and np.allclose(model["no"], no)
    x = np.array([[1.0] + [float(v == 1) for v in s["votes"]] + [float(v == 2) for v in s["votes"]] + [float(f) for f in s["features"]] for s in each])
    y, w = np.array([chance(s["votes"]) for s in each]), np.zeros(pii.WEIGHTS)
    for _ in range(200):
        w = w * (1 - 0.001) + x.T @ (y - 1 / (1 + np.exp(-x @ w))) / len(x)
    assert np.allclose(weights, w, atol=1e-9) and not any(math.isnan(v) for v in weights)
    texts, got = dict(rows), pii.personal_spans(docs).collect()
    shown = {texts[r["doc_id"]][s["start"] : s["end"]] for r in got for s in r["spans"] if s["kind"] == "name"}
    assert {"Anna Okafor", "Klaus Weber", "Dr. Stone"} <= shown and not shown & {"Oure Oure", "General Public", "Der Hund"}


def test_gazetteer_as_a_table(spark):
    """The caller's names count: with a list of one name its bearers are voted for, all others against; repeated and null entries and a null text do no harm."""
    rows = [(0, "it was Zorblat Quux who met Anna Stone"), (1, None), (2, "no names"), (3, "Dr. Zorblat Quux")]
    found = common.saved(pii.candidates(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("row", F.monotonically_increasing_id()), "t-candidates")
    names = spark.createDataFrame([("Zorblat",), ("Zorblat",), (None,)], "name string")
    got = {r["doc_id"]: [s["votes"][1] for s in r["spans"]] for r in pii.described(found, names).collect()}
    assert got == {0: [1, 2], 1: [], 2: [], 3: [1]}


def test_knn_join_sends_blocks_as_large_as_parts():
    """10^6 rows and 2 * 10^4 queries that meet every cell: the rows go out once, each query to about as many blocks as hold 20,000 rows."""
    r = np.random.default_rng(3)
    pivots = knn_join.Pivots(np.unique(r.normal(0, 1, (1000, 8)), axis=0))
    cells = pd.DataFrame({"cell": np.arange(-1, 1000), "n": [5, *[990] * 999, 45_000]})
    packs = knn_join.packed(pivots, cells, 20_000)
    assert sorted(packs["cell"]) == list(range(-1, 1000))
    sums = packs.merge(cells, on="cell").groupby("pack").agg(n=("n", "sum"), blocks=("blocks", "first"), cells=("cell", "count"))
    assert (sums["n"] <= 20_000 * sums["blocks"]).all() and (sums["cells"][sums["blocks"] > 1] == 1).all()
    assert sums["blocks"].max() == 3 and len(packs[packs["pack"] == packs["pack"][packs["cell"] == -1].iloc[0]]) == 1
    assert sums["blocks"].sum() <= 60  # 1.2 * 10^6 rows of queries, against 10^6 rows of data


@pytest.mark.parametrize("size", [1.0, 1e3, 1e7])
def test_knn_join_of_wide_components(spark, size):
    """Components of two, four and eight bytes, over more blocks and parts than shuffle partitions. The largest scores are held to a long and tie there, which bounds mustn't tell apart."""
    r = np.random.default_rng(8)
    x = r.normal(0, size, (300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    whole = [[int(c) for c in v] for v in np.floor(256 * x)]
    want = []
    for q in range(0, 300, 50):
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[i], strict=True)))), i) for i in range(300) if i != q)[:5]
        want += [(q, k, i, -s) for k, (s, i) in enumerate(scores, 1)]
    got = knn_join.knn_join(df, F.col("id") % 50 == 0, cell_rows=16, block_values=80, part_queries=2).collect()
    assert sorted((y["query_id"], y["rank"], y["vec_id"], y["score"]) for y in got) == sorted(want)
