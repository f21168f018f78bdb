"""Small tables with the hard cases: nulls, empty and long texts, repeated rows, ties, near copies, clashing column names."""

import random

EXTRA = "node long, sig string, spans string, ids string, kind string, score string, slot int, range string, lang_pred string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
WORDS = {"en": "the of and that with river stone winter market people house light garden because".split(), "de": "der die und nicht mit fluss stein winter markt leute haus licht garten weil".split(), "ru": "и не на что река камень зима рынок люди дом свет сад потому".split()}


def text_of(r: random.Random, lang: str, n: int) -> str:
    words = [r.choice(WORDS[lang]) + (r.choice("abcdefgh") if lang != "ru" else "") for _ in range(n)]
    return "\n".join(" ".join(words[i : i + 12]).capitalize() + "." for i in range(0, n, 12))


def near(r: random.Random, text: str, edits: int) -> str:
    words = text.split(" ")
    for _ in range(edits):
        words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
    return " ".join(words)


def documents(n: int = 120, seed: int = 1) -> list[tuple]:
    r, rows = random.Random(seed), []
    base = text_of(r, "en", 150)
    for i in range(n):
        lang = ("en", "de", "ru")[i % 3]
        text = near(r, base, r.randrange(0, 12)) if i % 4 == 0 else text_of(r, lang, r.randrange(1, 200))
        if i % 4 == 0:
            lang = "en"
        if i % 10 == 1:
            text += f" Mail me at a.b{i}@mail.example.com or +1 (555) 555-{1000 + i}, card 4111 1111 1111 1111, host 10.0.{i}.7 and 300.1.1.1."
        if i % 10 == 2:
            text += f' token = "{r.getrandbits(160):040x}" AKIA{"ABCDEFGH"[: 1 + i % 8] * 16} {r.getrandbits(120):x}'
        rows.append((i, text, lang, f"s{i % 5 if i % 3 else 0}", len(text)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n\t ", "en", "s1", 4), (n + 3, "12 34 !?", None, "s2", 8), (n + 4, "one two", "en", "s2", 7), (n + 5, "one two", "en", "s2", 7), (n + 5, "one two", "en", "s2", 7)]
    rows += [(None, rows[3][1], "en", "s3", 5), (n + 6, text_of(r, "de", 9000), "de", "s0", 1), (n + 7, "ſ é 漢字 ​ 😀 <|endoftext|> Σς", "en", "s0", 1), (n + 8, "a" * 50_000, "en", "s0", 1)]
    return [(*row, *("clash" if "string" in c else 1 for c in EXTRA.split(", "))) for row in rows]


def frame(spark, rows=None):
    rows = documents() if rows is None else rows
    return spark.createDataFrame(rows, SCHEMA).repartition(3)
