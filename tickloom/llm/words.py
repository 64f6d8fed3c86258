"""Words, word hashes and shingles of whole Arrow text columns in numpy.

Texts are handled as UTF-8 bytes in blocks of about a megabyte, so that memory
follows the block (or one very long text), never the partition. The six blanks
that end a word are single bytes in UTF-8, hence byte work finds the same words
as the pattern ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, so every power has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

_BYTES = np.arange(256)
BLANK = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LETTER = ((_BYTES | 0x20 >= 0x61) & (_BYTES | 0x20 <= 0x7A) & (_BYTES < 0x80)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on all input bits."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(which: str, n: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < n:
        step = np.full(max(n, 2 * len(have), BLOCK_BYTES), _BASE if which == "up" else _INVERSE, np.uint64)
        step[0] = 1
        have = _powers[which] = np.multiply.accumulate(step)
    return have[:n]


class Block:
    """Some whole texts: their bytes and where each begins."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.first, self.raw, self.offsets = first, data, offsets
        self.data = LOWER[data] if lower else data
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def runs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and per-text offsets of maximal runs of bytes in the table."""
        inside = table[self.data]
        edge = self.offsets[:-1][self.offsets[:-1] < len(inside)]
        opened = inside.copy()
        opened[1:] &= ~inside[:-1]
        opened[edge] = inside[edge]
        closed = inside.copy()
        closed[:-1] &= ~inside[1:]
        before = edge[edge > 0] - 1
        closed[before] = inside[before]
        starts, ends = np.flatnonzero(opened), np.flatnonzero(closed) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span; equal spans have equal hashes."""
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power("up", len(self.data)), out=self._sums[1:])
        spans = (self._sums[ends] - self._sums[starts]) * _power("down", len(self.data) + 1)[starts]
        return mix(spans + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.runs(~BLANK)

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words and where those of each text begin."""
        starts, ends, offsets = self.words()
        return self.hashes(starts, ends), offsets


def blocks(texts: pa.Array, lower: bool = True, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a string column into blocks of whole texts; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    ends = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    ends = ends.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, ends[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Block(first, data[ends[first] : ends[last]], ends[first : last + 1] - ends[first], lower)
        first = last


def runs_of_upper(block: Block, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each word has two capitals A-Z or more and no small a-z."""
    data = block.raw
    sums = np.concatenate([[0], np.cumsum((data >= 0x41) & (data <= 0x5A))])
    small = np.concatenate([[0], np.cumsum((data >= 0x61) & (data <= 0x7A))])
    return (sums[ends] - sums[starts] >= 2) & (small[ends] == small[starts])


def owners(offsets: np.ndarray) -> np.ndarray:
    """For each item the number of the text it belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def windows(hashes: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text, and the offsets per text."""
    count = np.maximum(np.diff(offsets) - size + 1, 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ends[-1]) + np.repeat(offsets[:-1] - ends[:-1], count)
    value = np.full(len(at), size, np.uint64)
    for k in range(size):
        value = value * np.uint64(0xA0761D6478BD642F) + hashes[at + k]
        value ^= value >> np.uint64(29)
    return mix(value), ends


def shingle_sets(block: Block, size: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its word shingles.

    A text with fewer than ``size`` words has its whole word sequence as the only
    shingle; a text without words has none.
    """
    hashes, offsets = block.word_hashes()
    value, ends = windows(hashes, offsets, size)
    out = []
    for k in range(len(block)):
        if ends[k] < ends[k + 1]:
            out.append(np.unique(value[ends[k] : ends[k + 1]]))
        elif offsets[k] < offsets[k + 1]:
            few = offsets[k + 1] - offsets[k]
            out.append(windows(hashes, offsets[k : k + 2], int(few))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out
