import random
from collections import Counter

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute, fixtures
from tests.llm.test_operators import jaccard_classes
from tidemark.llm import pfair_mix


def test_stages(spark, tmp_path):
    rows = fixtures.documents(80)
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = fixtures.frame(spark, rows).select(*names)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "secrets", "mixing", "tokens"]

    spoken = stages["language"](spark, docs, str(tmp_path)).cache()
    kept = Counter(r["doc_id"] for r in spoken.collect())
    assert spoken.columns == names
    assert all(any(c.isalpha() for c in r[1] or "") for r in rows if r[0] in kept)
    lettered = Counter(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))
    assert kept == lettered  # all of the fixture's texts are clear enough

    single = stages["near_duplicates"](spark, spoken, str(tmp_path)).cache()
    groups = jaccard_classes([(r["doc_id"], r["text"]) for r in spoken.collect()], 5, 80)
    assert Counter(r["doc_id"] for r in single.collect() if r["doc_id"] is not None) == Counter(i for i, _, c in set(groups) if i == c and i is not None)

    clean = stages["secrets"](spark, single, str(tmp_path)).cache()
    assert clean.columns == names and clean.count() == single.count()
    assert not any(brute.secrets_base(r["text"]) for r in clean.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())

    mixed = stages["mixing"](spark, clean, str(tmp_path)).cache()
    assert mixed.columns == names and Counter(map(tuple, mixed.collect())) == Counter(map(tuple, clean.collect()))

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r["doc_id"]: r["text"] for r in mixed.collect()}
    ids = {r["doc_id"]: r["ids"] for r in stages["tokens"](spark, mixed, str(tmp_path)).collect()}
    assert ids == {i: library.encode(t, add_special_tokens=False).ids for i, t in text.items()}

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(ids)


def test_empty_table(spark, tmp_path):
    docs = fixtures.frame(spark, []).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_mixing_keeps_all_of_a_large_source(spark):
    """One source has more text than its weight: its documents go on when most of the others have run out."""
    rows = [(i, f"{i} " * 30, "large" if i < 100 else f"s{i % 20}") for i in range(300)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    options = {"power": corpus_pipeline.MIX_WEIGHT_POWER, "total_weight": 25, "block_chars": 100}
    assert pfair_mix.mix(docs, **options).where("not in_mix").count() > 0
    assert Counter(r["doc_id"] for r in pfair_mix.mixed(docs, **options).collect()) == Counter(r[0] for r in rows)


def test_language_keeps_clear_mixed_texts(spark, tmp_path):
    """Texts in two and three languages in even parts stay; so does all with letters if there is nothing to learn from."""
    r = random.Random(21)
    part = lambda *langs: " ".join(fixtures.text_of(r, lang, 60) for lang in langs)
    plain = [(i, part(lang), lang) for i in range(60) for lang in (("en", "de", "ru")[i % 3],)]
    mixed = [(100 + i, part(*langs), None) for i in range(20) for langs in (("en", "de"), ("de", "en"), ("en", "ru", "de"), ("ru", "de", "en"))]
    docs = spark.createDataFrame([*plain, *mixed, (900, "12 34 !?", None), (901, None, None)], "doc_id long, text string, lang string")
    language = dict(corpus_pipeline.STAGES)["language"]
    want = Counter(i for i, _, _ in [*plain, *mixed])
    assert Counter(r["doc_id"] for r in language(spark, docs, str(tmp_path)).collect()) == want
    assert Counter(r["doc_id"] for r in language(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path)).collect()) == want


def test_near_duplicates_of_repeated_and_missing_ids(spark, tmp_path):
    """Two texts under one id are two documents; rows without an id are compared like others; names that the stages use themselves may come in."""
    r = random.Random(8)
    a, b, c, d = (fixtures.text_of(r, "en", 120) for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (2, a + " end"), (None, b + " end"), (None, c), (None, c + " end"), (9, d), (None, d), (7, ""), (7, ""), (None, None)]
    clash = ["_key", "_place", "_copy", "_lang_pred", "_lang_score", "_lang_certainty", "_mix_id", "_mix_tie", "_mix_slot", "_mix_place", "_mix_hash", "node", "root", "slot"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, *("x" for _ in clash)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in clash))
    stages = dict(corpus_pipeline.STAGES)
    found = stages["near_duplicates"](spark, docs, str(tmp_path))
    got = Counter((x["doc_id"], x["text"]) for x in found.collect())
    third = [x for x in got if x[0] is None and x[1] and x[1].startswith(c)]
    assert len(third) == 1 and got == Counter([(1, a), (1, b), third[0], (9, d), (7, ""), (None, None)])
    for name in ("language", "secrets", "mixing"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns and all(x[5:] == ("x",) * len(clash) for x in out.collect())
