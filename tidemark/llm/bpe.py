"""BPE encoding by backtracking, exact in linear time, and decoding by an offset table.

A word is encoded from left to right: the longest token that begins at a position (found by an Aho-Corasick automaton) is
taken if the pair that it forms with the token before it is compatible, that is, if merging the two tokens' joined bytes would
give just these two; else the next shorter token is tried, and when none is left the last token is taken back and that place is marked as
a dead end. Each place is marked once, so a word takes time in proportion to its length. Compatible neighbours
are enough: a sequence of tokens is what the merges give if each pair of neighbours is.

The vocabulary is a word-end BPE file of the tokenizers library (a path is a parameter; in the file, ids follow the order of merges):
texts are composed (NFC) and put in lower case, white space is dropped, words are split by the file's pattern, bytes stand for characters and the last byte of a word carries
the end mark. Special tokens found in a text keep their own ids. The file has no decoder, so decoding joins tokens by single spaces.
Texts with code points on which Unicode versions differ (see unsettled) are composed and put in lower case by the library's
normalizers, and such code points are split by the library's classes.

Defined cases: null or empty text: no ids, decoded to the empty string. Texts of any length are read whole; repeated rows
are encoded each for itself. Other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from . import common

#: Chunks between white space whose ids a worker remembers (about 60 MB when full), twice over: when so many are new, the older half that wasn't met again is forgotten.
REMEMBERED = 150_000
LONGEST_REMEMBERED = 40
#: More than any rank of a merge.
MANY = 1 << 60
SEPARATORS = re.compile("[\x1c-\x1f]")
ODD_SPACE = re.compile(r"[^\S\x1c-\x1f]+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next one from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    table, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            table[b] = chr(b)
        else:
            table[b] = chr(spare)
            spare += 1
    return table


@cache
def unsettled() -> re.Pattern:
    """Code points on which Python's and the library's Unicode tables may differ: those that Python doesn't know, combining or composed ones younger than Unicode 3.2 (older ones keep their normal forms for good), and all beyond the first plane (a search for one range is fast, for many it isn't)."""

    def differs(c: str) -> bool:
        known = unicodedata.category(c)
        return known == "Cn" or known != "Cs" and (unicodedata.combining(c) > 0 or unicodedata.decomposition(c) != "") and unicodedata.ucd_3_2_0.category(c) == "Cn"

    found = np.flatnonzero(np.fromiter((differs(chr(p)) for p in range(0x10000)), bool, 0x10000))
    cuts = np.flatnonzero(np.diff(found) > 1)
    runs = zip(found[np.append(0, cuts + 1)].tolist(), found[np.append(cuts, len(found) - 1)].tolist(), strict=True)
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "\\U00010000-\\U0010ffff]")


@cache
def stand_in(point: str) -> str:
    """A plain character of the class that the library gives a code point: letter, number or neither."""
    for name, plain in ((r"\p{L}", "x"), (r"\p{N}", "0")):
        if not pre_tokenizers.Split(Regex(name), "removed").pre_tokenize_str(point):
            return plain
    return "!"


LIBRARY_FORM = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])


class Pieces(dict):
    """The ids of chunks of text without white space, as the bytes of 32-bit numbers; encode is asked for those that aren't remembered."""

    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode, self.older = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece) or array("i", self.encode(piece)).tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[piece] = found
        return found


class Vocabulary:
    """Tables of one vocabulary file: splits, merged pairs, the automaton, next shorter tokens and decoding offsets."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        ids, self.end = model["vocab"], model["end_of_word_suffix"]
        self.pattern = regex.compile(next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        n = max(*ids.values(), *self.special.values()) + 1
        self.text = [""] * n
        for text, i in (ids | self.special).items():
            self.text[i] = text
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        # Symbols: one character for each byte, another for it with the end mark.
        self.byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.symbols: dict[int, str] = {i: self._symbols(text) for text, i in ids.items()}
        self.id_of = {s: i for i, s in self.symbols.items()}
        self.split: list[tuple[int, int]] = [(i, i) for i in range(n)]
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            i = ids[a + b]
            self.pair.setdefault((ids[a], ids[b]), i)
            if self.split[i] == (i, i):
                self.split[i] = (ids[a], ids[b])
        # Tokens that the merges of their own bytes don't give never come out of an encoding.
        self.reached = [False] * n
        for i in sorted(self.symbols):
            a, b = self.split[i]
            self.reached[i] = a == i or self.reached[a] and self.reached[b] and self.compatible(a, b, i)
        self.length = [len(self.symbols.get(i, "")) for i in range(n)]
        self.automaton = ahocorasick.Automaton()
        self.shorter: list[int] = [-1] * n
        for i, s in self.symbols.items():
            if self.reached[i]:
                self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        for i, s in self.symbols.items():
            for k in range(len(s) - 1, 0, -1):
                j = self.id_of.get(s[:k], -1)
                if j >= 0 and self.reached[j]:
                    self.shorter[i] = j
                    break
        pieces = [(x + " ").encode() for x in self.text]
        self.sizes = np.array([len(p) for p in pieces], np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.plain = [chr(0x4E00 + b) for b in range(256)]
        self.last = [chr(0x5E00 + b) for b in range(256)]
        self.pieces = Pieces(self.chunk)
        self.seen_pairs: dict[int, bool] = {}

    def _symbols(self, text: str) -> str:
        ended = text.endswith(self.end) and len(text) > len(self.end)
        own = [self.byte_of[c] for c in (text[: -len(self.end)] if ended else text)]
        return "".join(chr(0x4E00 + b) for b in own[:-1]) + chr((0x5E00 if ended else 0x4E00) + own[-1])

    def compatible(self, left: int, right: int, limit: int) -> bool:
        """Whether merges of rank under limit leave the two tokens side by side: walk down both sides of the boundary, latest merge first, and look for a merge across it that would have come before."""
        while True:
            across = self.pair.get((left, right))
            if across is not None and across < limit:
                return False
            # The later formed of the two is undone next; until it was formed, an earlier merge could cross.
            if left > right:
                part = self.split[left][1]
                if part == left:
                    return True
                limit, left = min(limit, left), part
            else:
                part = self.split[right][0]
                if part == right:
                    if self.split[left][1] == left:
                        return True
                    limit, left = min(limit, left), self.split[left][1]
                else:
                    limit, right = min(limit, right + 1), part

    def word(self, symbols: str) -> list[int]:
        """The tokens of one word."""
        n = len(symbols)
        whole = self.id_of.get(symbols)
        if whole is not None and self.reached[whole]:
            return [whole]
        # One pass finds the longest tokens end to end; those at other places are looked for when a shorter token leads there.
        longest, search = [-1] * n, self.automaton.iter_long
        for end, (k, i) in search(symbols):
            longest[end - k + 1] = i
        dead, out = bytearray(n + 1), []
        at, token, before = 0, longest[0], -1
        length, shorter, seen = self.length, self.shorter, self.seen_pairs
        if len(seen) > REMEMBERED:
            seen.clear()
        while at < n:
            while token >= 0:
                to = at + length[token]
                if not dead[to]:
                    if before < 0:
                        break
                    pair = before << 20 | token
                    fits = seen.get(pair)
                    if fits is None:
                        fits = seen[pair] = self.compatible(before, token, MANY)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before = to, token
                if at < n:
                    token = longest[at]
                    if token < 0:
                        token = longest[at] = next(search(symbols, at))[1][1]
            else:
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                before = out[-1] if out else -1
                token = shorter[token]
        return out

    def chunk(self, text: str) -> list[int]:
        """The ids of a piece of normalized text without white space."""
        ids: list[int] = []
        if text.isascii() or not unsettled().search(text):
            words = self.pattern.findall(text)
        else:
            shown = unsettled().sub(lambda m: stand_in(m[0]), text)
            words = [text[m.start() : m.end()] for m in self.pattern.finditer(shown)]
        for w in words:
            own = w.encode("utf-8")
            ids += self.word("".join([self.plain[b] for b in own[:-1]]) + self.last[own[-1]])
        return ids

    def encode(self, text: str) -> np.ndarray:
        if "<|" not in text:
            return np.frombuffer(self._ordinary(text), np.int32)
        ids: list[bytes] = []
        for part in self.special_pattern.split(text):
            if part in self.special:
                ids.append(array("i", [self.special[part]]).tobytes())
            elif part:
                ids.append(self._ordinary(part))
        return np.frombuffer(b"".join(ids), np.int32)

    def _ordinary(self, text: str) -> bytes:
        if text.isascii():
            text = text.lower()
        elif unsettled().search(text):
            text = LIBRARY_FORM.normalize_str(text)
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        # The separators U+001C to U+001F are white space to Python, but not to the file's pattern.
        pieces = ODD_SPACE.split(text) if SEPARATORS.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """The text of each run of ids; starts has one more entry than there are runs."""
        out = []
        i = 0
        n = len(starts) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(starts, starts[i] + 200_000, "right")) - 1)
            own = ids[starts[i] : starts[j]]
            size = self.sizes[own]
            to = np.cumsum(size)
            place = np.arange(to[-1] if len(to) else 0) + np.repeat(self.offsets[own] - (to - size), size)
            data = self.bytes[place].tobytes()
            edges = np.concatenate(([0], to))[starts[i : j + 1] - starts[i]]
            out += [data[a : max(a, b - 1)].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            i = j
        return out


@cache
def vocabulary(path: str) -> Vocabulary:
    """One for each worker process, kept between tasks."""
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, decoded: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array<int>) of each text, and if asked for the text that they decode to (in the same pass, so one set of workers serves both). path: a vocabulary file that is at the same place on every machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import vocabulary as shared

        vocab = shared(path)
        for batch in batches:
            texts = common.texts_of(batch.column(1))
            for i, j, _, _ in common.slices(texts):
                found = [vocab.encode(t) for t in texts.slice(i, j - i).to_pylist()]
                ends, flat = np.cumsum([0] + [len(x) for x in found]), np.concatenate(found)
                columns = [batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    columns.append(pa.array(vocab.decode(flat, ends), pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "ids", "decoded"][: 2 + decoded]
    schema = "doc_id long, ids array<int>" + ", decoded string" * decoded
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).transform(common.in_batches, run, schema)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and the text that they decode to. Null ids decode to the empty string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .bpe import vocabulary as shared

        vocab = shared(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                ids = part.column(1)
                starts = np.concatenate(([0], np.cumsum([n or 0 for n in ids.value_lengths().to_pylist()]))).astype(np.int64)
                decoded = vocab.decode(ids.flatten().to_numpy(zero_copy_only=False), starts)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).transform(common.in_batches, run, "doc_id long, ids array<int>, decoded string")
