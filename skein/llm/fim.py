"""Fill-in-middle by a piece table.

A document is a list of descriptors (buffer, start, end) over two buffers that never change: its text and the
sentinels. A cut splits a descriptor, an arrangement permutes them, the inverse permutation restores the document, and
texts and hashes are streamed from the descriptors, so nothing is copied before the output is written.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches
from skein.llm.text import hand_back

SEED = 7
#: Of 100 documents, how many are transformed, and how many of those put the suffix first.
FIM_PERCENT, SPM_PERCENT = 100, 50
TEXT, MARKS = 0, 1
#: Bytes of text that a task holds beside their outputs.
SLICE_BYTES = 4 << 20


class Piece(NamedTuple):
    buffer: int
    start: int
    end: int


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        names = [x.encode() for x in (self.prefix, self.suffix, self.middle)]
        if len(set(names)) < 3 or not all(names) or any(a in b for a in names for b in names if a != b):
            raise ValueError("sentinels must differ, and none may hold another")
        if any(a[:k] == b[-k:] for a in names for b in names for k in range(1, min(len(a), len(b)) + (a != b))):
            raise ValueError("no sentinel may begin as one ends, else the output could not be read back")

    def buffer(self) -> tuple[bytes, dict[str, Piece]]:
        """The sentinels' own immutable buffer, and the descriptor of each."""
        joined, at = b"", {}
        for key, value in (("P", self.prefix), ("S", self.suffix), ("M", self.middle)):
            at[key] = Piece(MARKS, len(joined), len(joined) + len(value.encode()))
            joined += value.encode()
        return joined, at


#: Order of (prefix, suffix, middle) parts in each form's output.
ARRANGEMENT = {"psm": "PSM", "spm": "SPM"}


def split(pieces: list[Piece], cut: int) -> list[Piece]:
    """The same text with a border at byte `cut`; a border that is there already gives an empty piece."""
    out, done = [], 0
    for p in pieces:
        inside = cut - done
        done += p.end - p.start
        if 0 <= inside <= p.end - p.start and cut >= 0:
            out += [Piece(p.buffer, p.start, p.start + inside), Piece(p.buffer, p.start + inside, p.end)]
            cut = -1
        else:
            out.append(p)
    return out


def arranged(parts: dict[str, Piece], form: str, marks: dict[str, Piece]) -> list[Piece]:
    return [piece for key in ARRANGEMENT[form] for piece in (marks[key], parts[key])]


def restored(output: bytes, form: str, names: dict[str, bytes]) -> list[Piece]:
    """Descriptors over `output` whose bytes, in order, are the document that was arranged."""
    if form == "plain":
        return [Piece(TEXT, 0, len(output))]
    starts, at = [], 0
    for key in ARRANGEMENT[form]:
        found = output.index(names[key], at)
        starts.append((key, found, found + len(names[key])))
        at = found + len(names[key])
    ends = [found for _, found, _ in starts[1:]] + [len(output)]
    parts = {key: Piece(TEXT, begin, end) for (key, _, begin), end in zip(starts, ends, strict=True)}
    return [parts[key] for key in "PMS"]


def stream(pieces: Iterable[Piece], buffers: list[memoryview]) -> Iterator[memoryview]:
    return (buffers[p.buffer][p.start : p.end] for p in pieces)


def digest(pieces: Iterable[Piece], buffers: list[memoryview]) -> str:
    h = hashlib.sha256()
    for part in stream(pieces, buffers):
        h.update(part)
    return h.hexdigest()


def line_ends(text: memoryview) -> np.ndarray:
    """Byte positions after each line `[^\\n]*\\n|[^\\n]+`."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not len(text) or (len(ends) and ends[-1] == len(text)) else np.append(ends, len(text))


def code_points(text: memoryview) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


def seed_words(id_: str | None, seed: int) -> list[int]:
    """The first four 8-digit groups of the hex SHA-256 of `seed:id`; a null id counts as an empty one."""
    h = hashlib.sha256(f"{seed}:{id_ or ''}".encode()).hexdigest()
    return [int(h[k : k + 8], 16) for k in (0, 8, 16, 24)]


_RESULT = pa.struct(
    [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string()), ("output_sha256", pa.string())]
)


def transform(text: memoryview, id_: str | None, marks: Sentinels, seed: int, fim: int, spm: int, keep_output: bool) -> tuple:
    """(n, form, prefix_chars, middle_chars, output or None, its SHA-256) of one document."""
    sentinels, at = marks.buffer()
    ends = line_ends(text)
    n = len(ends)
    h = seed_words(id_, seed)
    buffers = [text, memoryview(sentinels)]
    plain = not n or h[2] % 100 >= fim or any(s.encode() in text.obj for s in (marks.prefix, marks.suffix, marks.middle))
    pieces, form, sizes = [Piece(TEXT, 0, len(text))], "plain", (None, None)
    if not plain:
        cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        for cut in reversed(cuts):
            pieces = split(pieces[:1], int(ends[cut - 1]) if cut else 0) + pieces[1:]
        form = "spm" if h[3] % 100 < spm else "psm"
        parts = dict(zip("PMS", pieces, strict=True))
        sizes = tuple(code_points(text[parts[k].start : parts[k].end]) for k in "PM")
        pieces = arranged(parts, form, at)
    output = b"".join(stream(pieces, buffers)).decode() if keep_output else None
    return n, form, *sizes, output, digest(pieces, buffers)


def _rows(text: pa.Array, limit: int) -> Iterator[list[bytes]]:
    """The texts in runs of about `limit` bytes, a null one as empty."""
    own, size = [], 0
    for x in text:
        own.append(x.as_py() or b"")
        size += len(own[-1])
        if size > limit:
            yield own
            own, size = [], 0
    if own:
        yield own


def fill_in_middle(
    docs: DataFrame, sentinels: Sentinels | None = None, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
    carry: tuple[str, ...] | None = None, text_col: str = "text", id_col: str = "doc_id",
) -> DataFrame:
    """`docs` as a struct `doc` (all columns, or `carry`), and n, form, prefix_chars, middle_chars, output, output_sha256.

    A document is cut after two lines that the hash of its id chooses. Empty and null texts, texts that hold a
    sentinel, and those beyond `fim_percent` stay plain: their output is the text (empty for null) and the sizes of
    their parts are null. Rows that repeat an id are cut by the same numbers; every row stands for itself.
    """
    marks = sentinels or Sentinels()
    bounded_batches(docs.sparkSession)

    @F.arrow_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string,output_sha256:string>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, ids in batches:
            done, at = [], 0
            for own in _rows(texts, SLICE_BYTES):
                rows = [transform(memoryview(t), i, marks, seed, fim_percent, spm_percent, True) for t, i in zip(own, ids.slice(at, len(own)).to_pylist(), strict=True)]
                done.append(pa.array([dict(zip(_RESULT.names, r, strict=True)) for r in rows], _RESULT))
                at += len(own)
            yield pa.concat_arrays(done) if done else pa.array([], _RESULT)
        hand_back()

    made = run.asNondeterministic()(F.col(text_col).cast("binary"), F.col(id_col).cast("string"))
    return docs.select(F.struct(*(carry or ["*"])).alias("doc"), made.alias("__fim")).select("doc", "__fim.*")


def restore(output: Column, form: Column, sentinels: Sentinels | None = None, digest_only: bool = False) -> Column:
    """The document, or its SHA-256, rebuilt from an output and its form alone; null if either is null."""
    names = {k: v.encode() for k, v in zip("PSM", ((sentinels or Sentinels()).prefix, (sentinels or Sentinels()).suffix, (sentinels or Sentinels()).middle), strict=True)}

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            back = []
            for o, f in zip(outputs, forms, strict=True):
                o, f = o.as_py(), f.as_py()
                if o is None or f is None:
                    back.append(None)
                    continue
                pieces, buffers = restored(o, f, names), [memoryview(o)]
                back.append(digest(pieces, buffers) if digest_only else b"".join(stream(pieces, buffers)).decode())
            yield pa.array(back, pa.string())
        hand_back()

    return run.asNondeterministic()(output.cast("binary"), form)
