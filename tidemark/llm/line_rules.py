"""Line-first cleaning: rules on punctuation, navigation and boilerplate judge each line, failing lines are removed, and
a document that loses too much of its text is rejected.

Defined cases: null text counts as empty; a document without words fails the base rule (fewer than 50 words) and isn't kept; its cleaned text
is empty. Texts of any length are read whole. Repeated rows are judged each for itself; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
#: Words of menus, notices and scripts. A line of few words with one of them is boilerplate.
BOILERPLATE = re.compile(r"\b(cookies?|privacy policy|terms of (use|service)|all rights reserved|javascript|subscribe|sign (in|up)|log ?in|lorem ipsum|licen[sc]ed under|copyright|click here|read more)\b", re.I)
MAY_BE_BOILERPLATE = re.compile(r"cook|priv|terms|rights|javas|subsc|sign |log|lorem|licen|copyr|click|read m", re.I)
NAVIGATION = re.compile(r"[|»›>•]")
ENDS = (".", "!", "?", ":", ";", "…", '"', "'", ")", "”", "»", "。", "！", "？")


def line_fails(line: str, boilerplate_words: int = 15, symbol_share: float = 0.1) -> str:
    """The rule that the line fails, or an empty string. Lines of white space alone fail none."""
    bare = line.strip(" \t\r\v\f")
    if not bare:
        return ""
    words = bare.split()
    n = len(words)
    if n >= 3 and len(NAVIGATION.findall(bare)) >= 0.4 * n:
        return "navigation"
    if n <= boilerplate_words and MAY_BE_BOILERPLATE.search(bare) and BOILERPLATE.search(bare):
        return "boilerplate"
    if sum(map(bare.count, "#*$%&|<>")) > symbol_share * len(bare):
        return "symbols"
    if n >= 5 and bare.isupper():
        return "capitals"
    if n >= 8 and len(set(words)) * 3 <= n:
        return "repetition"
    if n >= 6 and not bare.endswith(ENDS):
        return "punctuation"
    return ""


def clean(text: str) -> tuple[str, int, int]:
    """The text without failing lines, the characters before and after (white space at the ends of lines left aside)."""
    before = after = 0
    kept = []
    for line in text.split("\n"):
        n = len(line.strip(" \t\r\v\f"))
        before += n
        if n and line_fails(line):
            continue
        after += n
        kept.append(line)
    return "\n".join(kept), before, after


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\r\v\f")]
    return len(lines) - len(set(lines))


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of three that are found twice or more."""
    if len(hashes) < 4:
        return 0
    w = common.windows(hashes, 3)
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    hit = np.flatnonzero(np.isin(w, twice))
    covered = np.zeros(len(hashes), bool)
    for j in range(3):
        covered[hit + j] = True
    return int(covered.sum())


def clean_lines(docs: DataFrame, most_lost: float = 0.4, least_words: int = 50, most_repeated: int = 50, with_cleaned: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost (share of characters in removed lines), cleaned (null unless with_cleaned)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = common.texts_of(batch.column(1))
            rows: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost", "cleaned")}
            for i, j, data, offsets in common.slices(texts):
                starts, ends, first = common.words(data, offsets)
                hashes = common.word_hashes(data, starts, ends)
                points = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~common._SPACE[data])))
                symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
                for r, text in enumerate(texts.slice(i, j - i).to_pylist()):
                    a, b = offsets[r], offsets[r + 1]
                    n, again = int(first[r + 1] - first[r]), repeated_words(hashes[first[r] : first[r + 1]])
                    failed = n < least_words or 100 * again > most_repeated * n
                    cleaned, before, after = clean(text)
                    lost = (before - after) / before if before else 0.0
                    for k, v in zip(rows, (n, int(points[b] - points[a]), int(symbols[b] - symbols[a]), duplicate_lines(text), again, failed, not failed and lost <= most_lost, lost, cleaned if with_cleaned else None), strict=True):
                        rows[k].append(v)
            types = [pa.int64()] * 5 + [pa.bool_(), pa.bool_(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(rows.values(), types, strict=True))], ["doc_id", *rows])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(
        common.in_batches, run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost double, cleaned string"
    )
