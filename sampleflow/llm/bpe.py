"""Byte-level BPE encoding and decoding in numpy, for a given vocabulary of ranks.

Texts are cut into pieces (letters, digits or other marks with the space before
them, white space, English contractions) by classes of code points, many texts at
once. The pieces that a worker hasn't met yet lie in one flat array of symbols; in
each round every piece merges its neighbouring pairs of least rank, looked up by
binary search in the sorted keys of all mergeable pairs, until no piece has any.

The vocabulary is a file of base64 tokens with their ranks; its path is a parameter,
and each worker reads it once. Decoding joins the tokens' bytes.

Defined cases: null text gives null, empty text no tokens, and the other way round;
a null or unknown id makes the decoded text null; bytes that aren't UTF-8 become
U+FFFD. Texts are encoded whole, whatever their length. Equal texts get equal
tokens. Extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import flat
from .spread import Ragged

#: Bytes of text that are cut at once, and pieces that a worker remembers.
CHUNK, REMEMBERED = 1 << 20, 100_000
_NONE = np.int64(1) << np.int64(40)
LETTER, DIGIT, SPACE, OTHER = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    points = "".join(map(chr, range(0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            out[m.start() : m.end()] = kind
    return out


def pieces(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where each piece begins among the code points of texts that begin at ``firsts``."""
    n = len(points)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[points]
    first = np.zeros(n, dtype=bool)
    first[firsts[firsts < n]] = True
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    ends = np.ones(n, dtype=bool)  # the last of a run
    ends[:-1] = change[1:]
    last = np.ones(n, dtype=bool)  # the last of a text
    last[:-1] = first[1:]
    # The last of some white space before anything else stands alone, or leads what follows if it is a space.
    tail = (kind == SPACE) & ends & ~last
    begin = change | tail
    leads = tail & (points == 32)
    begin[1:] &= ~leads[:-1]
    # An apostrophe alone, with s, t, m, d, re, ve or ll after it
    mark = np.flatnonzero((points == 39) & change & ends & begin & ~last)
    if len(mark):
        at = lambda k: np.where(mark + k < n, points[np.minimum(mark + k, n - 1)], 0)
        same = lambda k: ~first[np.minimum(mark + k, n - 1)] & (mark + k < n)
        a, b = at(1), at(2)
        one = np.isin(a, [ord(x) for x in "stmd"]) & same(1)
        two = np.zeros(len(mark), dtype=bool)
        for x in ("re", "ve", "ll"):
            two |= (a == ord(x[0])) & (b == ord(x[1]))
        two &= same(1) & same(2)
        for chosen, k in ((mark[one], 1), (mark[two], 2)):
            begin[chosen + 1] = False
            rest = chosen + k + 1
            rest = rest[rest < n]
            # the rest of the letters is a piece; a space that led them can't be there
            begin[rest[(kind[rest] == LETTER)]] = True
    return np.flatnonzero(begin)


class Vocabulary:
    def __init__(self, tokens: dict[bytes, int]):
        size = max(tokens.values()) + 1
        by_id = [b""] * size
        for token, rank in tokens.items():
            by_id[rank] = token
        self.known = np.zeros(size, dtype=bool)
        self.known[list(tokens.values())] = True
        self.lengths = np.array([len(t) for t in by_id], dtype=np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)
        self.single = np.array([tokens[bytes([k])] for k in range(256)], dtype=np.int64)
        pairs = [(tokens[t[:k]] << 32 | tokens[t[k:]], rank) for t, rank in tokens.items() for k in range(1, len(t)) if t[:k] in tokens and t[k:] in tokens]
        keys = np.array(sorted(pairs) or [(-1, 0)], dtype=np.int64)
        self.keys, self.merged = np.ascontiguousarray(keys[:, 0]), np.ascontiguousarray(keys[:, 1])
        self.met: dict[bytes, bytes] = {}

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Tokens of each word as int32, in rounds over all of them."""
        symbols = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        own = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_own = [], []
        while len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            rank = np.where((self.keys[at] == key) & (own[1:] == own[:-1]), self.merged[at], _NONE)
            rank = np.append(rank, _NONE)
            begin = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            least = np.minimum.reduceat(rank, begin)
            sizes = np.diff(np.append(begin, len(own)))
            goes = np.repeat(least, sizes)
            hit = (rank == goes) & (rank < _NONE)
            if not hit.any():
                break
            # of overlapping pairs the first, third ... are merged
            run = hit.copy()
            run[1:] &= ~hit[:-1]
            where = np.arange(len(hit))
            since = where - np.maximum.accumulate(np.where(run, where, 0))
            hit &= since % 2 == 0
            symbols = np.where(hit, rank, symbols)
            stays = np.ones(len(symbols), dtype=bool)
            stays[1:] = ~hit[:-1]
            over = goes == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_own.append(own[over])
                stays &= ~over
            symbols, own = symbols[stays], own[stays]
        whose = np.concatenate([*done_own, own])
        order = np.argsort(whose, kind="stable")
        out = np.concatenate([*done_symbols, symbols]).astype(np.int32)[order]
        cuts = np.searchsorted(whose[order], np.arange(len(words) + 1))
        raw = out.tobytes()
        return [raw[4 * i : 4 * j] for i, j in zip(cuts.tolist(), cuts[1:].tolist())]

    def tokens_of(self, words: list[bytes]) -> list[bytes]:
        new = [w for w in dict.fromkeys(words) if w not in self.met]
        if new:
            if len(self.met) + len(new) > REMEMBERED:
                self.met = {w: self.met[w] for w in words if w in self.met}
            self.met.update(zip(new, self.merge(new)))
        return [self.met[w] for w in words]

    def _encoded(self, texts: pa.Array) -> Iterator[tuple[flat.Chunk, Ragged]]:
        """The tokens of some texts at a time."""
        for c in flat.chunks(texts, CHUNK):
            raw = c.data.tobytes()
            points = np.frombuffer(raw.decode().encode("utf-32-le"), dtype=np.uint32)
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            byte = np.append(0, np.cumsum(width))
            start = byte[pieces(points, np.searchsorted(byte, c.cuts[:-1]))]
            end = np.append(start[1:], len(c.data))
            own = np.searchsorted(c.cuts, start, side="right") - 1
            sums = flat._sums(flat._BYTE[c.data], flat._BYTE_BASE)
            key = flat.mix((sums[end] - sums[start]) * flat._powers(flat._BYTE_BASE, len(c.data) + 1)[1][start])
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            tokens = self.tokens_of([raw[i:j] for i, j in zip(start[first].tolist(), end[first].tolist())])
            each = Ragged(np.array([len(t) // 4 for t in tokens], dtype=np.int64), np.frombuffer(b"".join(tokens), dtype=np.int32)).take(which)
            yield c, Ragged(np.bincount(own, weights=each.counts, minlength=len(c.rows)).astype(np.int64), each.values)

    def encode(self, texts: pa.Array) -> pa.Array:
        return self.encode_exact(texts, check=False).field("tokens")

    def encode_exact(self, texts: pa.Array, check: bool = True) -> pa.StructArray:
        """The tokens, and whether they decode to the text."""
        parts, exact = [], [np.zeros(0, dtype=bool)]
        for c, found in self._encoded(texts):
            parts.append(found)
            if check:
                ends = np.append(0, np.cumsum(self.lengths[found.values]))[np.append(0, np.cumsum(found.counts))]
                same = ends == c.cuts
                back = self.join(found.values)
                wrong = np.append(0, np.cumsum(back != c.data)) if len(back) == len(c.data) else np.arange(len(c.data) + 1)
                exact.append((np.diff(wrong[c.cuts]) == 0) & same[1:] & same[:-1])
        null = texts.is_null().to_numpy(zero_copy_only=False)
        counts = np.concatenate([np.zeros(0, np.int64), *(p.counts for p in parts)])
        offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32), mask=np.append(null, False))
        tokens = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *(p.values for p in parts)])))
        known = pa.array(np.concatenate(exact), mask=null) if check else pa.nulls(len(texts), pa.bool_())
        return pa.StructArray.from_arrays([tokens, known], ["tokens", "exact"])

    def join(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all the tokens."""
        count = self.lengths[ids]
        return self.bytes[np.repeat(self.begins[ids] - np.cumsum(count) + count, count) + np.arange(count.sum())]

    def decode(self, ids: pa.Array) -> pa.Array:
        ids = ids.cast(pa.large_list(pa.int64()))
        cuts = ids.offsets.to_numpy()
        values = ids.values.slice(cuts[0], cuts[-1] - cuts[0])
        missing = values.is_null().to_numpy(zero_copy_only=False)
        values = values.fill_null(-1).to_numpy()
        cuts = cuts - cuts[0]
        wrong = (values < 0) | (values >= len(self.known)) | missing
        values = np.where(wrong, 0, values)
        wrong |= ~self.known[values]
        bad = np.diff(np.append(0, np.cumsum(wrong))[cuts]) > 0
        null = ids.is_null().to_numpy(zero_copy_only=False) | bad
        out: list[str | None] = []
        low, ends = 0, np.append(0, np.cumsum(self.lengths[values]))
        while low < len(ids):  # some MB at a time
            high = max(low + 1, int(np.searchsorted(ends[cuts], ends[cuts[low]] + CHUNK, side="right")) - 1)
            part = values[cuts[low] : cuts[high]]
            raw, base = self.join(part).tobytes(), ends[cuts[low]]
            for k in range(low, high):
                out.append(None if null[k] else raw[ends[cuts[k]] - base : ends[cuts[k + 1]] - base].decode("utf-8", "replace"))
            low = high
        return pa.array(out, pa.string())


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as lines:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a})


def encoded(text: Column, path: str) -> Column:
    """array<int>: the tokens of a text."""

    @F.arrow_udf("array<int>")
    def encode(x: pa.Array) -> pa.Array:
        return vocabulary(path).encode(x)

    return encode(text.cast("string"))


def encoded_exact(text: Column, path: str) -> Column:
    """struct<tokens: array<int>, exact: boolean>: the tokens, and whether they decode to the text."""

    @F.arrow_udf("struct<tokens:array<int>,exact:boolean>")
    def encode(x: pa.Array) -> pa.Array:
        return vocabulary(path).encode_exact(x)

    return encode(text.cast("string"))


def decoded(ids: Column, path: str) -> Column:
    """The text of some tokens."""

    @F.arrow_udf("string")
    def decode(x: pa.Array) -> pa.Array:
        return vocabulary(path).decode(x)

    return decode(ids.cast("array<bigint>"))
