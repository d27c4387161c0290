"""Arrow-batch helpers: bounded slices of texts, and 64-bit hashes of all words of a buffer at once."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text worked on at a time; one longer text is a slice of its own.
SLICE_BYTES = 1 << 21
#: Bytes whose words are hashed at a time, up to the next white space.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def hand_back() -> None:
    """A worker lives on after its task; what it keeps only for speed goes back to the system."""
    for which, table in _powers.items():
        if len(table) > BLOCK_BYTES << 1:
            _powers[which] = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def _cuts(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """(first, number) of rows of about `limit` bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(column):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield first, last - first
        first = last


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as bytes) in slices of about `limit` bytes; a null text gives no bytes."""
    for batch in batches:
        for first, n in _cuts(batch.column(column), limit):
            rows = batch.slice(first, n)
            yield rows, [x or b"" for x in rows.column(column).to_pylist()]
    hand_back()


def per_text(text: Column, returns: str, load: Callable[[], Callable[[list[bytes]], pa.Array]], limit: int = SLICE_BYTES) -> Column:
    """A column worked out from whole texts in slices of about `limit` bytes; a null text counts as empty.

    `load` runs once in each task and gives the function from texts to an array of as many values. Only the text goes
    to Python and only the values come back; the other columns of a row stay in the JVM.
    """

    @F.arrow_udf(returns)
    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        work = load()
        for whole in arrays:
            parts = [work([x or b"" for x in whole.slice(first, n).to_pylist()]) for first, n in _cuts(whole, limit)]
            yield pa.concat_arrays(parts) if parts else work([])
        hand_back()

    return run.asNondeterministic()(text.cast("binary"))


def _grown(which: str, base: int, size: int) -> np.ndarray:
    have = _powers[which]
    if len(have) < size:
        n = 1 << (size - 1).bit_length()
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[which] = have = np.multiply.accumulate(steps)
    return have[:size]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that every bit depends on all."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def blocks(buffer: bytes, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Borders of parts of about `limit` bytes that begin after a space or line feed, or at the start."""
    at = 0
    while at < len(buffer):
        end = at + limit
        if end >= len(buffer):
            yield at, len(buffer)
            return
        cut = max(buffer.rfind(b" ", at, end), buffer.rfind(b"\n", at, end))
        if cut < 0:
            later = [x for x in (buffer.find(b" ", end), buffer.find(b"\n", end)) if x >= 0]
            cut = min(later) if later else len(buffer) - 1
        yield at, cut + 1
        at = cut + 1


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the runs of bytes, running sums, factors) that depend on nothing outside each run."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * _grown("up", _BASE, len(data)), out=sums[1:])
    down = _grown("down", _INVERSE, len(data) + 1)[starts]
    return mixed((sums[ends] - sums[starts]) * down + (ends - starts).astype(np.uint64)), sums, down


def joined_words(texts: list[bytes], table: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all texts: (buffer, starts, ends, hashes, text number of each word).

    `table` translates bytes and maps those that separate words to a space. The buffer joins the translated texts
    with a space, so byte positions inside a text keep their distance.
    """
    buffer = b" ".join(texts).translate(table)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    for at, end in blocks(buffer):
        data = np.frombuffer(buffer, np.uint8, end - at, at)
        edge = np.diff((data != 32).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        found.append((first + at, last + at, run_hashes(data, first, last)[0]))
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buffer, starts, ends, hashes, np.searchsorted(offsets, starts, side="right") - 1


def rolled(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for k in range(1, width):
        out *= np.uint64(_BASE)
        out += hashes[k : k + n]
    return mixed(out)


def translation(keep: str | bytes | None = None, drop: bytes = b"") -> bytes:
    """A table that lower-cases A-Z and maps to a space either all bytes but `keep` and those from 128, or just `drop`."""
    kept = keep.encode() if isinstance(keep, str) else keep
    out = bytearray(range(256))
    for b in range(256):
        low = b + 32 if 65 <= b <= 90 else b
        gone = (b in drop) if kept is None else (low not in kept and b < 128)
        out[b] = 32 if gone else low
    return bytes(out)


#: Words are runs of anything but ASCII white space.
BY_SPACE = translation(drop=b"\x20\x09\x0a\x0b\x0c\x0d")
#: Words are runs of ASCII letters, digits and everything beyond ASCII.
BY_LETTER = translation(keep="0123456789abcdefghijklmnopqrstuvwxyz")
