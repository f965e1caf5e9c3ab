"""Vectorised word splitting and hashing over UTF-8 bytes.

Word separators of every operator here are ASCII, so bytes can be classified
without decoding. All helpers work in pieces of bounded size: a batch of any
size, or one document of any length, needs memory for its words only, not for
several 8-byte arrays per character.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64
#: Characters hashed at once; a piece is cut at a separator.
PIECE = 1 << 17
#: Longer words are hashed by BLAKE2, so that position tables stay small.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain), elementwise."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _constants(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(n, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_POSITION = _constants(LONG_WORD, 11)
_SLOT = _constants(16, 23)


class Words:
    """A word definition: which bytes are in words, and whether A-Z equal a-z."""

    def __init__(self, word_bytes: np.ndarray, fold_case: bool):
        self.is_word = word_bytes
        values = _constants(256, 37)
        if fold_case:
            values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
        self.values = np.where(word_bytes, values, _U(0))
        self.fold_case = fold_case

    def spans(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end offsets of the words of buf."""
        inside = np.zeros(len(buf) + 2, dtype=np.int8)
        inside[1:-1] = self.is_word[buf]
        step = np.diff(inside)
        return np.flatnonzero(step == 1), np.flatnonzero(step == -1)

    def hashes(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(64-bit hash, start, end) of each word of data."""
        buf = np.frombuffer(data, dtype=np.uint8)
        parts, at = [], 0
        while at < len(buf):
            end = min(len(buf), at + PIECE)
            while end < len(buf) and self.is_word[buf[end]]:
                nxt = np.flatnonzero(~self.is_word[buf[end : end + PIECE]])
                end = end + int(nxt[0]) if len(nxt) else min(len(buf), end + PIECE)
            parts.append(self._piece(data, buf, at, end))
            at = end
        if not parts:
            none = np.zeros(0, dtype=np.int64)
            return np.zeros(0, dtype=_U), none, none
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _piece(self, data: bytes, whole: np.ndarray, at: int, end: int):
        buf = whole[at:end]
        starts, ends = self.spans(buf)
        if not len(starts):
            return np.zeros(0, dtype=_U), starts, ends
        body = buf[starts[0] :]
        first = starts - starts[0]
        place = np.arange(len(body), dtype=np.int32) - np.repeat(first.astype(np.int32), np.diff(first, append=len(body)))
        np.minimum(place, LONG_WORD - 1, out=place)
        h = np.add.reduceat(self.values[body] * _POSITION[place], first)
        size = (ends - starts).astype(_U)
        h = mix(h + size * _U(0x9E3779B97F4A7C15))
        for i in np.flatnonzero(size > LONG_WORD):
            word = data[at + int(starts[i]) : at + int(ends[i])]
            word = word.translate(_FOLD) if self.fold_case else word
            h[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h, starts + at, ends + at


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_byte = np.arange(256)
#: Words [^\x20\x09-\x0D]+
SPACED = (_byte != 0x20) & ~((_byte >= 0x09) & (_byte <= 0x0D))
#: Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
ALNUM = ((_byte >= 0x30) & (_byte <= 0x39)) | ((_byte >= 0x41) & (_byte <= 0x5A)) | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)

spaced_folded = Words(SPACED, fold_case=True)
spaced_exact = Words(SPACED, fold_case=False)
alnum_folded = Words(ALNUM, fold_case=True)


def chunks(texts: list[bytes], limit: int = 16 * PIECE):
    """Yields (first index, texts) with at most limit bytes, or one text."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield start, texts[start:i]
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, texts[start:]


def split_words(words: Words, texts: list[bytes]):
    """(hash, start, end, text index, joined bytes, bounds) over texts joined by blanks.

    bounds[i]:bounds[i + 1] are the words of text i.
    """
    joined = b" ".join(texts)
    h, starts, ends = words.hashes(joined)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
    bounds = np.searchsorted(starts, offsets)
    return h, starts, ends, joined, offsets, bounds


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every size consecutive elements (none if fewer)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=_U)
    out = np.zeros(n, dtype=_U)
    for k in range(size):
        out += h[k : k + n] * _SLOT[k]
    return mix(out + _U(size))


def sliced(batches, rows: int = 1024):
    """Arrow batches in slices of few rows, so that what is made of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as bytes; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
