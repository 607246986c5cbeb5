"""Vectorised words and hashes over whole Arrow text columns.

Words are found and hashed with numpy on the UTF-8 bytes of many texts at
once; no Python object exists per word. A word's hash is a polynomial over its
bytes modulo 2**64, taken as a difference of prefix sums, then mixed. Window
hashes are polynomials over word hashes, by prefix sums as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes hashed at once.
BLOCK = 1 << 20
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)
_WINDOW = 0xA0761D6478BD642F
_WINDOW_INV = pow(_WINDOW, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers (splitmix finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class _PowerTable:
    """Powers of a base and of its inverse, grown as needed."""

    def __init__(self, base: int, inverse: int) -> None:
        self.base, self.inverse = base, inverse
        self.up = self.down = np.ones(1, U64)

    def __reduce__(self) -> tuple:
        return _PowerTable, (self.base, self.inverse)  # tables are made anew, not sent

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            if n > 1 << 25:  # one very long text: not kept
                return _powers(self.base, n), _powers(self.inverse, n)
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


_BYTES = _PowerTable(_BASE, _BASE_INV)
_WORDS = _PowerTable(_WINDOW, _WINDOW_INV)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and the number that stands for each byte."""

    is_word: np.ndarray
    value: np.ndarray

    @staticmethod
    def of(separators: bytes, lower: bool) -> Alphabet:
        """Words are runs of bytes outside ``separators`` (ASCII only)."""
        is_word = np.ones(256, bool)
        is_word[list(separators)] = False
        value = mix(np.arange(1, 257, dtype=U64) * U64(_STEP))
        if lower:
            value[65:91] = value[97:123]
        return Alphabet(is_word, value)


#: Words of ``[^\x20\x09-\x0D]+``, unchanged.
BLANK_SEPARATED = Alphabet.of(bytes([0x20, *range(0x09, 0x0E)]), lower=False)
#: Words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
ALPHANUMERIC = Alphabet.of(
    bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]),
    lower=True,
)


@dataclass
class Words:
    """The words of some texts; word ``i`` of text ``d`` is ``offsets[d] + i``."""

    data: np.ndarray  # bytes of all texts
    starts: np.ndarray  # first byte of each word
    ends: np.ndarray  # byte after each word
    hashes: np.ndarray
    offsets: np.ndarray  # words before each text, and in all

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of_words(self) -> np.ndarray:
        """The text's number for each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def _blocks(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Runs of words of about ``BLOCK`` bytes, so that temporary arrays stay small."""
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, n, BLOCK)), len(starts)))
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def words_of(texts: pa.Array, alphabet: Alphabet) -> Words:
    """All words of ``texts`` (null: none), in order."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offset_buffer, data_buffer = texts.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64 if wide else np.int32)[
        texts.offset : texts.offset + len(texts) + 1
    ].astype(np.int64)
    if data_buffer is None or offsets[-1] == offsets[0]:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint8), none, none, none.astype(U64), np.zeros(len(texts) + 1, np.int64))
    data = np.frombuffer(data_buffer, np.uint8)[offsets[0] : offsets[-1]]
    offsets -= offsets[0]
    n = len(data)
    inside = alphabet.is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.zeros(len(starts), U64)
    for low, high in _blocks(starts, n):
        begin = starts[low]
        part = data[begin : ends[high - 1]]
        up, down = _BYTES.get(len(part))
        sums = np.zeros(len(part) + 1, U64)
        np.cumsum(alphabet.value[part] * up, out=sums[1:])
        at, to = starts[low:high] - begin, ends[low:high] - begin
        hashes[low:high] = mix((sums[to] - sums[at]) * down[at] + (to - at).astype(U64) * U64(_STEP))
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets))


def window_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First words of all windows of ``size`` words within one text, and hashes."""
    n = len(words.hashes)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    up, down = _WORDS.get(n)
    sums = np.zeros(n + 1, U64)
    np.cumsum(words.hashes * up, out=sums[1:])
    stop = np.repeat(words.offsets[1:], words.counts)
    at = np.flatnonzero(np.arange(size, n + size) <= stop)
    return at, mix((sums[at + size] - sums[at]) * down[at])


def span_hashes(words: Words, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of given runs of words; equal to ``window_hashes`` for one size."""
    n = len(words.hashes)
    up, down = _WORDS.get(max(n, 1))
    sums = np.zeros(n + 1, U64)
    np.cumsum(words.hashes * up[:n], out=sums[1:])
    return mix((sums[starts + sizes] - sums[starts]) * down[starts])
