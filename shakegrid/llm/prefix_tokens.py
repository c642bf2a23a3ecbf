"""Token counts by prefix dynamic programming (operator 11): the exact count at every prefix of a text.

For tokenizers of the library ``tokenizers`` with a BPE model whose words end in a mark, such as word_bpe_49k.json. The first
tokens of an encoded word encode what they cover, and two tokens may be neighbours only if merging their symbols ends in
the same two. So one pass over a word suffices: ``inner`` holds, for each prefix that goes on, its only possible last
token and its count; ``final``, for each prefix that ends there, the count with the one ending token that fits behind an
inner prefix. Words are independent, so the count at a place of a text is that of the words before and of the begun one.
Tables of words between white space are kept (the latest CACHE_CHARS to twice as many characters a worker); a text's table is
theirs with running sums. Nothing is ever encoded again: ``tokens_at`` reads a count, ``longest_within`` the longest prefix for
a budget.

A text is normalised, split and freed of special strings as the library does by default: a special string is one token.
Prefixes are of code points of the text as it is. A place between a letter and combining marks that the normaliser may
join, or inside what it turns into several letters, is no place to cut: its count is null. Null and empty texts have 0
tokens. Long texts and long words are tabled whole, linear in their length. Repeated rows are counted each; further
columns pass through, but for those named like the outputs, which are replaced.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from tokenizers import Tokenizer

from .common import append

# White space (Unicode White_Space) and the pattern of words, as the tokenizer file has them.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: PATTERN where a letter beyond ASCII is written as one private character and a numeral as another.
CLASSED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[A-Za-z\ue001]+|[0-9\ue002]|[^A-Za-z0-9\ue001\ue002]+")
GAP = re.compile(f"[{SPACES}]+")
IS_SPACE = np.array([bool(GAP.match(chr(c))) for c in range(0x3002)])
END = "\u0100"
CACHE_CHARS, CACHE_PAIRS, CACHED = 2_000_000, 500_000, 200
NONE: dict[str, bool] = {}
#: Bytes of text that a task tables at once; a table takes four bytes a code point, twice.
SLICE = 1 << 20


@lru_cache(maxsize=1)
def joining() -> frozenset[str]:
    """Characters that canonical composition may join to what stands before them."""
    pairs = (unicodedata.decomposition(chr(c)) for c in range(sys.maxunicode + 1))
    seconds = {chr(int(d.split()[1], 16)) for d in pairs if d and d[0] != "<" and " " in d}
    return frozenset(seconds | {chr(c) for c in range(0x1161, 0x1176)} | {chr(c) for c in range(0x11A8, 0x11C3)})


def byte_letters() -> dict[int, str]:
    """The character, one for each byte, that stands for a letter of the vocabulary."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{256 + i: chr(b) for i, b in enumerate(others)}}


class Classes(dict):
    """For str.translate: ASCII as it is, other characters as their class, asked of the tokenizer once."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__((c, c) for c in range(128))
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, code: int) -> int:
        letter, numeral = (len(self.split(f"{x}{chr(code)}{y}")) for x, y in (("a", "a"), ("!", "!")))
        # One piece among letters, or one among signs; a numeral is alone in both.
        self[code] = out = 0xE001 if letter == 1 else 0xE003 if numeral == 1 else 0xE002
        return out


class Lowered(dict):
    """For str.translate: a character normalised on its own; \x00 where what stands beside it matters, or it becomes several."""

    def __init__(self, tokenizer: Tokenizer):
        self.normal = tokenizer.normalizer.normalize_str

    def __missing__(self, code: int) -> str:
        c = chr(code)
        out = self.normal(c)
        alone = len(out) == 1 and not unicodedata.combining(c) and c not in joining() and unicodedata.is_normalized("NFC", c)
        self[code] = out = out if alone else "\x00"
        return out


class Counter:
    """Prefix tables of one tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        mark = model["end_of_word_suffix"]
        if model["type"] != "BPE" or not mark or model.get("unk_token") or model.get("continuing_subword_prefix"):
            raise ValueError("this operator takes BPE models with an end-of-word mark")
        if [n["type"] for n in spec["normalizer"]["normalizers"]] != ["NFC", "Replace", "Lowercase"] or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": PATTERN}:
            raise ValueError("this operator takes lower-casing tokenizers that cut words by its PATTERN")
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] or GAP.search(a["content"]) for a in added):
            raise ValueError("special strings must be plain and without white space")
        names = sorted((a["content"] for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, names))) if names else None
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.classes, self.lowered = tokenizer.normalizer.normalize_str, Classes(tokenizer), Lowered(tokenizer)
        letters = byte_letters()

        def plain(token: str) -> str:
            ends = token.endswith(mark) and token != mark
            return (token[: -len(mark)] if ends else token).translate(letters) + END * ends

        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(plain(a), plain(b)): i for i, (a, b) in enumerate(pairs)}
        found: dict[str, list] = {}
        self.firsts: dict[str, list] = {}
        self.lasts: dict[str, list] = {}
        for token in map(plain, model["vocab"]):
            if self.built(token):
                found.setdefault(token.removesuffix(END), [None, None])[token.endswith(END)] = token
        self.tokens = ahocorasick.Automaton()
        for bare, (inner, final) in found.items():
            self.tokens.add_word(bare, (len(bare), inner, final))
        self.tokens.make_automaton()
        #: By token: which tokens may follow it, as far as asked.
        self.fits: dict[str, dict[str, bool]] = {}
        self.asked = 0
        self.words: dict[str, list[int]] = {}
        self.tables: dict[str, tuple[bytes, int]] = {}
        #: What was kept before: used words come back from it, the others go when the newer caches are full.
        self.older: tuple[dict, dict] = {}, {}
        self.kept = 0

    @staticmethod
    def symbols(token: str) -> list[str]:
        return [*token[:-2], token[-2:]] if token.endswith(END) else list(token)

    def built(self, token: str) -> bool:
        """Whether the model's merges, lowest rank first, leftmost first, make ``token`` of its symbols.

        Keeps which symbols were its first and its last, each with the rank of the merge that ended it.
        """
        symbols, never = self.symbols(token), float("inf")
        firsts, lasts = [], []
        while len(symbols) > 1:
            rank, at = min((self.rank.get(pair, never), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == never:
                return False
            if not at:
                firsts.append((symbols[0], rank))
            if at == len(symbols) - 2:
                lasts.append((symbols[-1], rank))
            symbols = [*symbols[:at], symbols[at] + symbols[at + 1], *symbols[at + 2 :]]
        self.firsts[token], self.lasts[token] = [*firsts, (token, never)], [*lasts, (token, never)]
        return True

    def neighbours(self, a: str, b: str) -> bool:
        """Whether the symbols of ``a`` and ``b`` together end as these two: no merge joins them before both are whole.

        What is made has a higher rank than its parts, so both sides are followed by rank.
        """
        lasts, firsts, i, j, out = self.lasts[a], self.firsts[b], 0, 0, True
        while out:
            (x, x_ends), (y, y_ends) = lasts[i], firsts[j]
            joined = self.rank.get((x, y))
            if joined is not None and joined < x_ends and joined <= y_ends:
                out = False
            elif x_ends == y_ends == float("inf"):
                break
            elif x_ends <= y_ends:
                i += 1
            else:
                j += 1
        self.asked += 1
        if self.asked > CACHE_PAIRS:
            self.asked = 0
            self.fits.clear()
        self.fits.setdefault(a, {})[b] = out
        return out

    def prefix_table(self, word: str) -> list[int]:
        """Counts of the prefixes of a word of 1, 2, ... bytes (a character each), as words of their own.

        One step for each token that occurs in the word; the automaton gives them by their ends, so what stands
        before a token is known when it is met.
        """
        n = len(word) + 1
        last, inner, final, follow = [""] * n, [0] * n, [0] * n, [self.fits] * n
        for end, (size, goes_on, ends) in self.tokens.iter(word):
            end += 1
            before = end - size
            if goes_on is not None and not inner[end]:
                fits = before == 0 or follow[before].get(goes_on)
                if fits or fits is None and self.neighbours(last[before], goes_on):
                    last[end], inner[end], follow[end] = goes_on, inner[before] + 1, self.fits.get(goes_on, NONE)
            if ends is not None and not final[end]:
                fits = before == 0 or follow[before].get(ends)
                if fits or fits is None and self.neighbours(last[before], ends):
                    final[end] = inner[before] + 1
        return final[1:]

    def word(self, text: str) -> list[int]:
        """Counts at the prefixes of 1, 2, ... characters of a word of the pattern."""
        counts = self.words.get(text)
        if counts is None and (counts := self.older[0].get(text)):
            self.words[text] = counts
        if counts is None:
            if text.isascii():
                counts = self.prefix_table(text)
            else:
                word = text.encode().decode("latin-1")
                # A character ends where no continuation byte follows.
                counts = [c for c, after in zip(self.prefix_table(word), word[1:] + " ") if not "\x80" <= after <= "\xbf"]
            if text[0] == "'" and len(text) == 3 and text[1].isalpha():
                # A contraction cut short falls into its mark and a letter.
                counts[1] = counts[0] + self.word(text[1])[0]
            if len(text) <= CACHED:
                self.words[text] = counts
        return counts

    def plain(self, text: str) -> list[int]:
        """Counts at the prefixes of 1, 2, ... characters of normalised text without white space."""
        out, before = [], 0
        for m in CLASSED.finditer(text.translate(self.classes) if not text.isascii() else text):
            counts = self.word(text[m.start() : m.end()])
            out += [before + c for c in counts] if before else counts
            before = out[-1]
        return out

    def segment(self, text: str) -> list[int]:
        """Counts at the prefixes of text without white space and special strings; -1 where it can't be cut."""
        if text.isascii():
            return self.plain(text.lower())
        whole = text.translate(self.lowered)
        if "\x00" not in whole:
            return self.plain(whole)
        whole = self.normal(text)
        units = [text[0]]
        for c in text[1:]:
            if unicodedata.combining(c) or c in joining():
                units[-1] += c
            else:
                units.append(c)
        sizes = [len(self.normal(u)) for u in units]
        if sum(sizes) != len(whole):
            units, sizes = [text], [len(whole)]
        counts, out, at = [0, *self.plain(whole)], [], 0
        for unit, size in zip(units, sizes):
            at += size
            out += [-1] * (len(unit) - 1) + [counts[at]]
        return out

    def chunk(self, chunk: str) -> tuple[bytes, int]:
        """Counts (int32) at the prefixes of text without white space, and of the whole; -1 where it can't be cut."""
        out = self.older[1].get(chunk)
        if out is None:
            out = self.counted(chunk)
        if len(chunk) <= CACHED:
            if self.kept > CACHE_CHARS:
                self.older = self.words, self.tables
                self.words, self.tables, self.kept = {}, {}, 0
            self.tables[chunk] = out
            self.kept += len(chunk)
        return out

    def counted(self, chunk: str) -> tuple[bytes, int]:
        counts, before, start = [], 0, 0
        for m in self.special.finditer(chunk) if self.special else ():
            begun = self.segment(chunk[start : m.end() - 1])
            own = self.segment(chunk[start : m.start()])[-1] if m.start() > start else 0
            counts += [c if c < 0 else c + before for c in begun]
            before += own + 1
            counts.append(before)
            start = m.end()
        if start < len(chunk):
            counts += [c if c < 0 else c + before for c in self.segment(chunk[start:])]
        return array("i", counts).tobytes(), counts[-1]

    def prefixes(self, text: str | None) -> np.ndarray:
        """Counts at the prefixes of 0, 1, ... code points; -1 where the text can't be cut."""
        text = text or ""
        make = self.chunk
        tables = [self.tables.get(c) or make(c) for c in GAP.split(text) if c]
        out = np.zeros(len(text) + 1, np.int32)
        if not tables:
            return out
        space = IS_SPACE[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), len(IS_SPACE) - 1)]
        begun = ~space
        begun[1:] &= space[:-1]
        at = np.cumsum(begun, dtype=np.int32)
        totals = np.zeros(len(tables) + 1, np.int32)
        np.cumsum([n for _, n in tables], out=totals[1:])
        own = np.frombuffer(b"".join([b for b, _ in tables]), np.int32)
        inside = own + totals[at[~space] - 1]
        inside[own < 0] = -1
        out[1:][~space] = inside
        out[1:][space] = totals[at[space]]
        return out


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def reach(counts: np.ndarray) -> np.ndarray:
    """Code points of the longest prefix with at most 0, 1, ... tokens; the last entry is the whole text."""
    at = np.flatnonzero(counts >= 0)
    out = np.zeros(int(counts.max()) + 1, np.int32)
    np.maximum.at(out, counts[at], at.astype(np.int32))
    return np.maximum.accumulate(out)


def prefix_counts(df: DataFrame, path: str, column: str = "text") -> DataFrame:
    """``df`` with prefix_tokens (array of int: tokens of the first 0, 1, ... code points) and token_reach (by number of tokens: the longest prefix)."""

    def lists(arrays: list[np.ndarray], nulls: bool) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        flat = np.concatenate(arrays)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, mask=flat < 0 if nulls else None))

    def fn(texts: pa.Array) -> list[pa.Array]:
        own = counter(path)
        counts = [own.prefixes(t) for t in texts.to_pylist()]
        return [lists(counts, True), lists([reach(c) for c in counts], False)]

    return append(df, column, [T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("prefix_tokens", "token_reach")], fn, SLICE)


def tokens_at(chars: Column | int | None = None) -> Column:
    """Tokens of the first ``chars`` code points, of the whole text by default; null where the text can't be cut or ends before."""
    return F.element_at("prefix_tokens", -1) if chars is None else F.get("prefix_tokens", F.lit(chars) if isinstance(chars, int) else chars)


def longest_within(tokens: int) -> Column:
    """Code points of the longest prefix with at most ``tokens`` tokens."""
    return F.get("token_reach", F.least(F.lit(tokens), F.size("token_reach") - 1))
