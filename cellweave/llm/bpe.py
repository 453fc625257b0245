"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word there is one token that ends its encoding. It is found among the
vocabulary's tokens that end there (one run of a suffix-linked automaton over the word gives
them all) as the only one that is compatible with the last token of what stands before it;
back-pointers then give the ids. Two tokens are compatible when no merge crosses the border
between them: each side's border symbols live from the merge that makes them to the one that
consumes them, and a merge of two that live at a time, if it comes before either is
consumed, would have crossed.

The vocabulary file is the usual JSON of a BPE with byte symbols and an end-of-word suffix;
its path is a parameter and each Python worker reads it once, so it must be readable there.

Defined cases: null counts as empty; empty texts have no ids and decode to an empty text; the
strings of special tokens in a text become those tokens; repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .common import pieces

#: Fixed values of the tokenizer: how words are split, and what ends a word.
SPLIT = r"[\p{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same where all characters are below U+0100, for the quicker standard matcher.
NARROW_SPLIT = r"[{L}]+|'s|'t|'re|'ve|'m|'ll|'d|[{N}]|[^\t-\r \x85\xa0{L}{N}]+".format(L="A-Za-zªµºÀ-ÖØ-öø-ÿ", N="0-9²³¹¼½¾")
WORD_END = "</w>"
#: Capitals that are younger than this Python's Unicode, with their small letters.
NEWER_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}
#: Entries of one generation; the one before is kept beside it.
CACHE_WORDS = 75_000
CACHE_PAIRS = 75_000
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints, else one from 256 on."""
    printing = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, spare = [], 0x100
    for b in range(256):
        out.append(chr(b if b in printing else spare))
        spare += b not in printing
    return out


class Recent(dict):
    """A memo of two generations: what was asked for in the last one outlives a change."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


class Bpe:
    """Tokens are their numbers here; a pair of tokens is one number too."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END or spec.get("decoder"):
            raise ValueError("not a BPE vocabulary with word ends and without decoder")
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ids.values(), *self.special.values()])
        self.bits = size.bit_length()
        texts = [""] * size
        for token, i in (*ids.items(), *self.special.items()):
            texts[i] = token
        self.texts = pa.array(texts)
        self.bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.at_special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.word, self.narrow_word = regex.compile(SPLIT), re.compile(NARROW_SPLIT)
        self.newer = re.compile("[" + "".join(map(chr, NEWER_LOWER)) + "]")
        self.symbols = byte_symbols()
        self.merge: dict[int, int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        for k, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ", 1)
            x, y, whole = ids[a], ids[b], ids[a + b]
            self.merge[x << self.bits | y] = k
            self.parts[whole] = self.parts[whole] or (x, y)
        self.spines: list[list[list[tuple[int, int]] | None]] = [[None] * size, [None] * size]
        self.fits = Recent(self.compatible, CACHE_PAIRS)
        self.words = Recent(self.pack, CACHE_WORDS)
        # tokens that end a word, by what stands before its end; the automaton has the others
        self.endings: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton()
        usable = [True] * size
        rank = lambda i: self.merge[self.parts[i][0] << self.bits | self.parts[i][1]] if self.parts[i] else -1
        for token, i in sorted(ids.items(), key=lambda t: rank(t[1])):
            if self.parts[i]:
                a, b = self.parts[i]
                usable[i] = usable[a] and usable[b] and not self.crossed(a, b, rank(i))
            if not usable[i]:
                continue
            if token.endswith(WORD_END):
                self.endings[token.removesuffix(WORD_END)] = i
            else:
                self.automaton.add_word(token, (len(token), i))
        self.automaton.make_automaton()

    def spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """Symbols at one border of a token, each with the rank of the merge that consumes it."""
        out = self.spines[side][token]
        if out is None:
            out, whole = [(token, NEVER)], token
            while (parts := self.parts[whole]) is not None:
                rank, whole = self.merge[parts[0] << self.bits | parts[1]], parts[side]
                out.append((whole, rank))
            self.spines[side][token] = out
        return out

    def crossed(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether some merge over the border comes before its sides are consumed, and before ``until``.

        At equal ranks merges go from left to right.
        """
        merge, right_side = self.merge, self.spine(right, 0)
        for a, a_end in self.spine(left, 1):
            first = a << self.bits
            for b, b_end in right_side:
                rank = merge.get(first | b, NEVER)
                if rank < a_end and rank < until and rank <= b_end:
                    return True
        return False

    def compatible(self, pair: int) -> bool:
        return not self.crossed(pair >> self.bits, pair & ((1 << self.bits) - 1))

    def tokens(self, word: str) -> list[int]:
        """Tokens of one word, given in byte symbols without its end."""
        endings, bits, fits = self.endings, self.bits, self.fits
        if word in endings:
            return [endings[word]]
        n = len(word)
        before, start_of = [-1] * (n + 1), [0] * (n + 1)
        # matches come by their ends, so that all that stands before a match is known
        for last, (length, token) in self.automaton.iter(word):
            end = last + 1
            if before[end] < 0:
                start = end - length
                if start == 0 or fits[before[start] << bits | token]:
                    before[end], start_of[end] = token, start
        for end in range(1, n + 1):
            last = endings.get(word[end:], -1)
            if last >= 0 and fits[before[end] << bits | last]:
                break
        else:
            raise ValueError(f"no encoding of {word!r}")
        out = [last]
        while end:
            out.append(before[end])
            end = start_of[end]
        return out[::-1]

    def pack(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit numbers."""
        return b"".join([self.bytes[i] for i in self.tokens("".join([self.symbols[b] for b in word.encode()]))])

    def split(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text)
        # every character by itself: no sign takes another form at the end of a word
        text = text.lower() if "Σ" not in text else "".join([c.lower() for c in text])
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer.search(text):
                text = text.translate(NEWER_LOWER)
            return self.word.findall(text)
        return self.narrow_word.findall(text)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        parts = self.at_special.split(text or "") if self.at_special else [text or ""]
        return b"".join([self.bytes[self.special[p]] if p in self.special else self.encode_plain(p) for p in parts])

    def encode_plain(self, text: str) -> bytes:
        self.words.turn()
        self.fits.turn()
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def decode(self, ids: list[bytes]) -> pa.Array:
        """Texts of lists of ids: without a decoder of its own the vocabulary's tokens are joined by spaces."""
        ends = np.cumsum([0, *[len(x) // 4 for x in ids]])
        tokens = self.texts.take(pa.array(np.frombuffer(b"".join(ids), "<u4")))
        return pc.binary_join(pa.LargeListArray.from_arrays(ends, tokens), " ")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def encode_rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    bpe = vocabulary(path)
    for batch in batches:
        for part in pieces(batch, "text", 1 << 20):
            ids = [bpe.encode(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), bpe.decode(ids)],
                ["doc_id", "n_tokens", "ids", "decoded"])
    # the worker may serve other stages next
    bpe.words.old, bpe.fits.old = {}, {}


def encode(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian 32-bit numbers), decoded."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(lambda b: encode_rows(b, path), "doc_id long, n_tokens long, ids binary, decoded string")
