"""Personal data by weak supervision, in DataFrame functions only.

Patterns give candidate spans. Labelers (shape, gazetteer, context, checksum, counter-context, repetition) vote for or against each or abstain. Expectation-
maximisation over the counts of vote patterns estimates the share of true spans and how reliable each labeler is; its
posteriors are the soft labels on which a logistic span classifier over votes and shape features is trained. Base
spans are always reported; other candidates are if the classifier gives them half or more and they overlap no base span.

Names are proposed by their capitals; the gazetteer of given names is a table that a caller may bring, and one labeler among others.

Only counts of vote and feature patterns (3^6 votes by 2^6 features at most) ever meet in one place, however large the corpus.

Defined cases: null or empty text: no spans. Texts of any length are read whole; positions count code points. Repeated rows are handled each for itself.
Without candidates no model is needed. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order in which they are reported: (name, cheap test, pattern). The first four are the base kinds. Patterns never
#: look at a run of characters from each of its places: they start where the run does, or where the last match ended. Loops over
#: groups are possessive or bounded: others recurse in Java's matcher and exhaust the stack on long texts.
KINDS = (
    ("email", "@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", r"[0-9](?:[ -]?[0-9]){15}", r"[0-9](?:[ -]?+[0-9])++"),
    ("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("tel", r"[0-9]{3}[ .-][0-9]{4}", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])"),
    ("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    ("iban", r"[A-Z]{2}[0-9]{2}[ A-Z0-9]{11}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("mail", r"[\[(](?:at|AT)[\])]", r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]++)++"),
    ("name", r"\p{Lu}\p{Ll}*\.? \p{Lu}\p{Ll}", r"(?<![\p{L}\p{N}_])(?:(?:Mr|Mrs|Ms|Dr|Prof)\b\.? \p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){0,2}+|\p{Lu}\p{Ll}++(?: \p{Lu}\p{Ll}++){1,2}+)(?![\p{L}\p{N}_])"),
)
NAMES = tuple(k for k, _, _ in KINDS)
BASE = NAMES[:4]
NAME = NAMES.index("name")
#: Given names of the gazetteer that is used if a caller brings none.
GIVEN_NAMES = tuple("""
    Alan Albert Alexander Alice Ana Andrea Andrew Angela Anna Anne Antonio Barbara Brian Camille Carlos Carmen Catherine Charles Charlotte Chloe Christian Claire Claudia David Deborah Diego Donald
    Edward Elena Elizabeth Emily Emma Fernando Francisco François Frank Gabriel George Gertrud Hans Heinrich Helen Henri Hugo Isabel Isabelle Jacques James Javier Jean Jennifer Jessica Johann John
    Jorge José Joseph Juan Julia Julie Jürgen Karen Karin Karl Klaus Laura Linda Lisa Louis Lucas Lucía Luis Manuel Margaret Maria Marie Mark Martin Mary María Matthew Michael Michel Miguel Monika
    Nancy Nicolas Olivier Pablo Patricia Paul Pedro Peter Philippe Pierre Richard Robert Ruth Sabine Sandra Sarah Sofía Sophie Stefan Steven Susan Thomas Ursula Walter William Wolfgang
""".split())
#: Mail hosts and the country codes of account and phone numbers.
KNOWN_PARTS = r"@(?:[^@]*\.)?(?:gmail|yahoo|hotmail|outlook|example|mail)\.|^(?:DE|FR|GB|ES|IT|NL|AT|CH|BE|PL|SE)[0-9]{2}|^\+(?:1|33|34|39|44|49)[^0-9]"
TITLE = r"^(?:Mr|Mrs|Ms|Dr|Prof)\b\.? ?"
CONTEXT = r"(?i)\b(?:e-?mail|mailto|contact|phone|tel|call|mobile|fax|card|visa|account|iban|bank|ssn|social security|ip|address|host|from|name|dear|signed|by)\W{0,4}\w{0,8}\W{0,3}$"
COUNTER = r"(?i)\b(?:version|isbn|issn|order|invoice|ticket|part|serial|model|page|section|figure|build|release|doi)\W{0,4}\w{0,6}\W{0,3}$|[$€£v]$"
#: Where a sentence or a line begins.
SENTENCE = r"(?:^|[.!?:\n])\s*$"
LABELERS = 6
FEATURES = 6


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, digit(i)).when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2)) % 10 == 0


def passes(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def chunked(rows: Column, size: int = 128) -> Column:
    """The array in slices of at most size."""
    return F.when(F.size(rows) == 0, F.slice(F.array(rows), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / size).cast("int")), lambda c: F.slice(rows, c * size + 1, size)))


def scanned(rows: Column, zero: Column, total_: Callable[[Column], Column], combine: Callable[[Column, Column], Column], value: Callable[[Column, Column], Column], after: Callable[[Column, Column], Column]) -> Column:
    """For each row value(state, row), where state is `zero` combined with what precedes the row. A fold that appends to an
    array copies it in each step, so it runs over short slices, each from the state that the slices before it leave (total_ of each)."""

    def fold(items: Column, start: Column, each: Callable[[Column, Column], Column], next_: Callable[[Column, Column], Column]) -> Column:
        none = F.slice(F.array(each(start, items[0])), 1, 0)
        step = lambda a, x: F.struct(next_(a["state"], x).alias("state"), F.concat(a["out"], F.array(each(a["state"], x))).alias("out"))
        return F.aggregate(items, F.struct(start.alias("state"), none.alias("out")), step, lambda a: a["out"])

    def of_chunks(chunks: Column) -> Column:
        starts = fold(F.transform(chunks, total_), zero, lambda s, t: s, combine)
        return F.flatten(F.zip_with(chunks, starts, lambda c, s: fold(c, s, value, after)))

    return F.when(F.size(rows) > 0, bound(chunked(rows), of_chunks))


def found_spans(text: Column, kind: str) -> Column:
    """Array of (kind, start, end, match, before) of the kind's leftmost matches: the pieces between matches and the matches add up to the text."""
    _, cheap, pattern = next(k for k in KINDS if k[0] == kind)
    number = NAMES.index(kind)
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # After the last match a piece is left over.
    pairs = F.filter(F.zip_with(matches, pieces, lambda m, p: F.struct(m.alias("m"), p.alias("p"), F.length(p).cast("long").alias("lead"), F.length(m).cast("long").alias("own"))), lambda x: x["m"].isNotNull())

    def placed(at: Column, x: Column) -> Column:
        start = at + x["lead"]
        return F.struct(F.lit(number).alias("kind"), start.alias("start"), (start + x["own"]).alias("end"), x["m"].alias("match"), F.substring(x["p"], -30, 30).alias("before"))

    add = lambda at, x: at + x["lead"] + x["own"]
    whole = lambda chunk: F.aggregate(chunk, F.lit(0).cast("long"), add)
    spans = bound(pairs, lambda rows: scanned(rows, F.lit(0).cast("long"), whole, lambda a, b: a + b, placed, add))
    guard = text.contains(cheap) if cheap == "@" else text.rlike(cheap)
    return F.coalesce(F.when(guard, F.filter(spans, lambda s: passes(kind, s["match"]))), F.expr("cast(array() as array<struct<kind:int,start:bigint,end:bigint,match:string,before:string>>)"))


def apart(added: Column, base: Column) -> Column:
    """The spans of added that overlap none of base: in order of start, none before reaches beyond the span's start, and none after begins before its end."""
    far = F.lit(1 << 60)
    row = lambda s, own: F.struct(s["start"].alias("at"), s["end"].alias("to"), F.lit(own).alias("own"), s.alias("span"))
    rows = F.array_sort(F.concat(F.transform(base, lambda s: row(s, 0)), F.transform(added, lambda s: row(s, 1))))

    def reach(x: Column) -> Column:
        return F.when(x["own"] == 0, x["to"]).otherwise(-far)

    def begin(x: Column) -> Column:
        return F.when(x["own"] == 0, x["at"]).otherwise(far)

    def open_left(sorted_: Column) -> Column:
        return scanned(sorted_, -far, lambda c: F.aggregate(c, -far, lambda a, x: F.greatest(a, reach(x))), F.greatest, lambda s, x: F.struct(x["at"].alias("at"), x["to"].alias("to"), x["own"].alias("own"), x["span"].alias("span"), (s <= x["at"]).alias("free")), lambda s, x: F.greatest(s, reach(x)))

    def open_right(back: Column) -> Column:
        return scanned(back, far, lambda c: F.aggregate(c, far, lambda a, x: F.least(a, begin(x))), F.least, lambda s, x: F.struct((x["free"] & (x["own"] == 1) & (s >= x["to"])).alias("keep"), x["span"].alias("span")), lambda s, x: F.least(s, begin(x)))

    kept = F.reverse(bound(F.reverse(bound(rows, open_left)), open_right))
    return F.when((F.size(added) == 0) | (F.size(base) == 0), added).otherwise(F.transform(F.filter(kept, lambda x: x["keep"]), lambda x: x["span"]))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its candidate spans by kind; those of the added kinds only where they overlap no base span."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    each = docs.select(F.col(id_col).cast("long").alias("doc_id"), *(found_spans(text, k).alias(f"k{i}") for i, k in enumerate(NAMES)))
    base, added = F.concat(*(f"k{i}" for i in range(4))), F.concat(*(f"k{i}" for i in range(4, len(NAMES))))
    return each.select("doc_id", base.alias("base"), added.alias("added")).select("doc_id", F.concat("base", apart(F.col("added"), F.col("base"))).alias("spans"))


def given(match: Column) -> Column:
    """The word of a name that stands first, after a title."""
    return F.regexp_extract(F.regexp_replace(match, TITLE, ""), r"^\p{Lu}\p{Ll}+", 0)


def votes(s: Column, known: Column) -> list[Column]:
    """For each labeler 1 (for), 2 (against) or 0 (abstains). known: the words of the row's names that the gazetteer holds. The pattern that proposes names looks at capital letters alone, so title, gazetteer, context and repetition each see something else."""
    digits = F.length(F.regexp_replace(s["match"], "[^0-9]", ""))
    kind, match, before = s["kind"], s["match"], s["before"]
    shape = F.when(kind == 0, F.when(match.rlike(r"^[^@]{1,64}@.*\.[A-Za-z]{2,24}$"), 1).otherwise(2)).when(kind == 3, F.when(match.rlike(r"[ ().-]"), 1).otherwise(0)).when(kind == 1, F.when(match.rlike(r"^(?:0|127)\.|\.0\.0$"), 2).otherwise(1)).when(kind == NAME, F.when(match.rlike(TITLE), 1).when(before.rlike(SENTENCE), 2).otherwise(0)).otherwise(1)
    listed = F.when(kind == NAME, F.array_contains(known, given(match))).otherwise(match.rlike(KNOWN_PARTS))
    # After a title a family name may stand alone, so a list of given names has nothing to say against it.
    gazetteer = F.when(listed, 1).when(kind.isin(0, 7) | ((kind == NAME) & ~match.rlike(TITLE)), 2).otherwise(0)
    context = F.when(before.rlike(CONTEXT), 1).otherwise(0)
    checksum = F.when(kind == 2, 1).when(kind == 5, F.when(match.rlike("^(?:000|666|9)"), 2).otherwise(1)).when(kind.isin(3, 4), F.when(digits.between(10, 13), 1).otherwise(2)).otherwise(0)
    counter = F.when(before.rlike(COUNTER), 2).otherwise(0)
    same = F.when(F.regexp_replace(match, "[^0-9]", "").rlike(r"^([0-9])\1{6,}$") | ((kind == NAME) & match.rlike(r"(\p{Lu}\p{Ll}+) \1(?: |$)")), 2).otherwise(0)
    return [shape, gazetteer, context, checksum, counter, same]


def features(s: Column) -> list[Column]:
    """Shape features of the classifier beside the votes, each 0 or 1."""
    match, before = s["match"], s["before"]
    tests = [s["kind"] < 4, s["kind"] == NAME, F.length(match) > 20, match.rlike("[A-Za-z]"), (before == "") | before.endswith("\n"), before.rlike(r"[A-Za-z0-9]$")]
    return [F.when(t, 1).otherwise(0) for t in tests]


def described(spans: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """The spans (saved, with a number in `row`) with votes (array<int>) and features (array<int>) beside each. gazetteer (name): a table of any size, joined with the different first words of each row's names."""
    words = spans.select("row", F.explode(F.array_distinct(F.transform(F.filter("spans", lambda s: s["kind"] == NAME), lambda s: given(s["match"])))).alias("name"))
    listed = words.join(gazetteer.select(F.col("name").cast("string").alias("name")), "name", "left_semi").groupBy("row").agg(F.collect_set("name").alias("known"))
    both = spans.join(listed, "row", "left").withColumn("known", F.coalesce("known", F.expr("cast(array() as array<string>)")))
    each = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.array(*votes(s, F.col("known"))).alias("votes"), F.array(*features(s)).alias("features"))
    return both.select("doc_id", F.transform("spans", each).alias("spans"))


def bound(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def total(rows: Column, term) -> Column:
    return F.aggregate(rows, F.lit(0.0), lambda a, r: a + term(r))


def em(patterns: Column, rounds: int = 30) -> Column:
    """(prior, yes, no) after the rounds: yes[j][v] is the chance that labeler j votes v on a true span, no[j][v] on another. patterns: array of (votes, n)."""

    def likelihood(p: Column, table: Column) -> Column:
        out = table[0][p["votes"][0]]
        for j in range(1, LABELERS):
            out = out * table[j][p["votes"][j]]
        return out

    def step(state: Column, _: Column) -> Column:
        def with_posterior(p: Column) -> Column:
            a, b = state["prior"] * likelihood(p, state["yes"]), (1 - state["prior"]) * likelihood(p, state["no"])
            return F.struct(p["votes"].alias("votes"), (p["n"] * a / (a + b)).alias("y"), (p["n"] * b / (a + b)).alias("x"))

        def maximised(q: Column) -> Column:
            def table(part: str) -> Column:
                whole = total(q, lambda r: r[part])
                return F.array(*(F.array(*((total(q, lambda r, j=j, v=v: F.when(r["votes"][j] == v, r[part]).otherwise(0.0)) + 1.0) / (whole + 3.0) for v in range(3))) for j in range(LABELERS)))

            y, x = total(q, lambda r: r["y"]), total(q, lambda r: r["x"])
            return F.struct(((y + 1.0) / (y + x + 2.0)).alias("prior"), table("y").alias("yes"), table("x").alias("no"))

        return bound(F.transform(patterns, with_posterior), maximised)

    start = lambda v: F.array(*(F.array(*map(F.lit, v)) for _ in range(LABELERS)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(F.lit(0.5).alias("prior"), start((0.3, 0.6, 0.1)).alias("yes"), start((0.3, 0.1, 0.6)).alias("no")), step)


def inputs(votes_: Column, features_: Column) -> Column:
    """The classifier's inputs: 1, votes for, votes against, features."""
    return F.concat(F.array(F.lit(1.0)), F.transform(votes_, lambda v: F.when(v == 1, 1.0).otherwise(0.0)), F.transform(votes_, lambda v: F.when(v == 2, 1.0).otherwise(0.0)), F.transform(features_, lambda v: v.cast("double")))


WEIGHTS = 1 + 2 * LABELERS + FEATURES


def sigmoid(inputs_: Column, weights: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.aggregate(F.zip_with(inputs_, weights, lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)))


def logistic(rows: Column, steps: int = 200, rate: float = 1.0, decay: float = 0.001) -> Column:
    """Weights that fit the soft labels y of rows (x, y, n) by gradient descent."""
    n = F.greatest(total(rows, lambda r: r["n"].cast("double")), F.lit(1.0))

    def step(w: Column, _: Column) -> Column:
        errors = F.transform(rows, lambda r: F.struct(r["x"].alias("x"), (r["n"] * (r["y"] - sigmoid(r["x"], w))).alias("e")))
        zero = F.array(*(F.lit(0.0) for _ in range(WEIGHTS)))
        gradient = F.aggregate(errors, zero, lambda g, r: F.zip_with(g, r["x"], lambda a, v: a + v * r["e"]))
        return F.zip_with(w, gradient, lambda a, g: a * (1 - rate * decay) + g * rate / n)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array(*(F.lit(0.0) for _ in range(WEIGHTS))), step)


def train(spans: DataFrame) -> tuple[list[float], dict]:
    """The classifier's weights, and the EM's estimates, from described spans."""
    each = spans.select(F.explode("spans").alias("s")).groupBy(F.col("s.votes").alias("votes"), F.col("s.features").alias("features")).agg(F.count("*").cast("double").alias("n"))
    rows = each.agg(F.array_sort(F.collect_list(F.struct("votes", "features", "n"))).alias("rows"))
    rows = rows.withColumn("em", em(F.col("rows")))
    label = lambda r: F.struct(inputs(r["votes"], r["features"]).alias("x"), posterior(r["votes"], F.col("em")).alias("y"), r["n"].alias("n"))
    one = rows.select("em", F.transform("rows", label).alias("rows")).select("em", logistic(F.col("rows")).alias("w")).first()
    return list(one["w"]), one["em"].asDict(recursive=True)


def posterior(votes_: Column, model: Column) -> Column:
    a, b = model["prior"], 1 - model["prior"]
    for j in range(LABELERS):
        a, b = a * model["yes"][j][votes_[j]], b * model["no"][j][votes_[j]]
    return a / (a + b)


def personal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, gazetteer: DataFrame | None = None) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, base, score), in the order of KINDS, then start. gazetteer (name): given names; GIVEN_NAMES if None."""
    names = docs.sparkSession.createDataFrame([(n,) for n in GIVEN_NAMES], "name string") if gazetteer is None else gazetteer
    found = common.saved(candidates(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii-candidates")
    spans = common.saved(described(found, names), "pii")
    weights = F.array(*map(F.lit, train(spans)[0]))
    scored = F.transform("spans", lambda s: F.struct(s["kind"].alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.element_at(F.array(*map(F.lit, NAMES)), s["kind"] + 1).alias("kind"), (s["kind"] < len(BASE)).alias("base"), sigmoid(inputs(s["votes"], s["features"]), weights).alias("score")))
    return spans.select("doc_id", F.array_sort(F.filter(scored, lambda s: s["base"] | (s["score"] >= least))).alias("spans"))
