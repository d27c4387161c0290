"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of bytes from both ends. Every byte looks up its input to the gate and the candidate, the
state moves towards the candidate by the gate (squashing is x / (1 + |x|) throughout, which numpy does fast), and
the two states at a position give that position's language probabilities. A document's probabilities are the means
over all its positions. Training is backpropagation through time in numpy on a bounded sample.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, hash_rank, id_mod, rank_bound
from skein.llm.text import per_text, text_slices

WINDOW, STATE = 128, 8
#: Labelled documents of each language and windows of each that training takes at most, on average.
TRAIN_PER_LANGUAGE, TRAIN_WINDOWS = 600, 6
TRAIN_STEPS = 400
#: Names of languages that training takes at most.
TRAIN_LANGUAGES = 256
#: Windows that run side by side.
BATCH = 2048
UNDETERMINED = "und"
_PAD = 256


@dataclass
class Network:
    """table (2, 257, 2h): input of each byte to gate and candidate, for both directions; u (2, 2h, h); v (k, 2h + 1)."""

    languages: list[str]
    table: np.ndarray
    u: np.ndarray
    v: np.ndarray

    @property
    def state(self) -> int:
        return self.u.shape[2]


def windows_of(texts: list[bytes], width: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """((width, n) byte numbers with pads at the end, text number of each window); every byte is in one window."""
    counts = [-(-len(t) // width) for t in texts]
    out = np.full((sum(counts), width), _PAD, np.int16)
    at = 0
    for text, n in zip(texts, counts, strict=True):
        if n:
            out[at : at + n].reshape(-1)[: len(text)] = np.frombuffer(text, np.uint8)
            at += n
    return np.ascontiguousarray(out.T), np.repeat(np.arange(len(texts)), counts)


def forward(net: Network, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """(states (width, 2h, n), what backpropagation needs); a pad leaves the state as it is."""
    width, n = x.shape
    h = net.state
    state = np.zeros((2, h, n), np.float32)
    states, kept = np.empty((width, 2, h, n), np.float32), []
    a, b = np.empty((2, 2 * h, n), np.float32), np.empty((2, 2 * h, n), np.float32)
    for k in range(width):
        np.matmul(net.u, state, out=a)
        a[0] += net.table[0].take(x[k], axis=0).T
        a[1] += net.table[1].take(x[width - 1 - k], axis=0).T
        np.abs(a, out=b)
        b += 1
        a /= b
        if keep:
            kept.append((a.copy(), state.copy()))
        gate, change = a[:, :h], a[:, h:]
        gate *= 0.5
        gate += 0.5
        change -= state
        change *= gate
        state += change
        states[k, 0] = state[0]
        states[width - 1 - k, 1] = state[1]
    return states.reshape(width, 2 * h, n), kept


def position_probabilities(net: Network, states: np.ndarray) -> np.ndarray:
    """(width, k, n)"""
    out = np.matmul(net.v[:, :-1], states)
    out += net.v[:, -1:, None].transpose(2, 0, 1)
    out -= out.max(axis=1, keepdims=True)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over the positions that are no pads, and its gradients."""
    width, n = x.shape
    h = net.state
    states, kept = forward(net, x, keep=True)
    p = position_probabilities(net, states)
    real = (x != _PAD).astype(np.float32)
    total = max(1.0, float(real.sum()))
    loss = -float((np.log(np.maximum(p[:, y, np.arange(n)], 1e-9)) * real).sum()) / total
    p[:, y, np.arange(n)] -= 1
    p *= real[:, None, :] / total
    dv = np.concatenate([np.einsum("wkn,whn->kh", p, states), p.sum(axis=(0, 2))[:, None]], axis=1)
    ds = np.matmul(net.v[:, :-1].T, p).reshape(width, 2, h, n)
    du, da_all = np.zeros_like(net.u), np.empty((width, 2, 2 * h, n), np.float32)
    dh = np.zeros((2, h, n), np.float32)
    for k in reversed(range(width)):
        a, before = kept[k]
        dh[0] += ds[k, 0]
        dh[1] += ds[width - 1 - k, 1]
        gate, change = 0.5 + 0.5 * a[:, :h], a[:, h:]
        slope = (1 - np.abs(a)) ** 2
        da = np.concatenate([dh * (change - before) * 0.5, dh * gate], axis=1) * slope
        du += np.matmul(da, before.transpose(0, 2, 1))
        dh = dh * (1 - gate) + np.matmul(net.u.transpose(0, 2, 1), da)
        da_all[k] = da
    dt = np.zeros_like(net.table)
    for side, seen in ((0, x), (1, x[::-1])):
        flat = da_all[:, side].transpose(0, 2, 1).reshape(-1, 2 * h)
        for c in range(2 * h):
            dt[side, :, c] = np.bincount(seen.ravel(), weights=flat[:, c], minlength=257)
    dt[:, _PAD] = 0
    return loss, {"table": dt.astype(np.float32), "u": du, "v": dv.astype(np.float32)}


def new_network(languages: list[str], state: int = STATE, seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.5, (2, 257, 2 * state)).astype(np.float32)
    table[:, :, :state] -= 0.5
    table[:, _PAD, :state] = -1e9
    table[:, _PAD, state:] = 0
    u = rng.normal(0, 0.3, (2, 2 * state, state)).astype(np.float32)
    return Network(languages, table, u, rng.normal(0, 0.1, (len(languages), 2 * state + 1)).astype(np.float32))


def train(texts: list[bytes], names: list[str], epochs: int = 8, batch: int = 256, rate: float = 0.02, windows: int = TRAIN_WINDOWS, seed: int = 5, least_steps: int = TRAIN_STEPS) -> Network:
    """A network for the distinct `names`, by Adam on every position of up to `windows` windows of each text.

    Small samples are gone through more often, so that there are `least_steps` steps.
    """
    net = new_network(sorted(set(names)))
    if not net.languages:
        return net
    x, owner = windows_of(texts)
    rng = np.random.default_rng(seed)
    mixed = rng.permutation(len(owner))
    mixed = mixed[np.argsort(owner[mixed], kind="stable")]
    rank = np.arange(len(mixed)) - np.searchsorted(owner[mixed], owner[mixed])
    chosen = mixed[rank < windows]
    x = x[:, chosen]
    y = np.array([net.languages.index(n) for n in names])[owner[chosen]]
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("table", "u", "v")}
    step = 0
    epochs = max(epochs, -(-least_steps * batch // max(1, len(y)))) if len(y) else 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for first in range(0, len(order), batch):
            own, step = order[first : first + batch], step + 1
            _, grads = gradients(net, np.ascontiguousarray(x[:, own]), y[own])
            now = rate * (1 - epoch / epochs)
            for k, g in grads.items():
                m, s = moments[k]
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                getattr(net, k)[...] -= now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
            net.table[:, _PAD, : net.state] = -1e9
    return net


def _pieces(texts: list[bytes], room: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, parts of texts) of about `room` bytes at a time; `room` is a multiple of a window."""
    owners, parts, size = [], [], 0
    for d, text in enumerate(texts):
        for first in range(0, len(text), room):
            part = text[first : first + room]
            owners.append(d)
            parts.append(part)
            size += len(part)
            if size >= room:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


def document_probabilities(net: Network, texts: list[bytes], batch: int = BATCH) -> np.ndarray:
    """(n, k): the mean over all positions of each text; zeros for an empty text."""
    sums = np.zeros((len(texts), len(net.languages)))
    for owners, parts in _pieces(texts, batch * WINDOW):
        x, owner = windows_of(parts)
        for first in range(0, len(owner), batch):
            part = np.ascontiguousarray(x[:, first : first + batch])
            p = position_probabilities(net, forward(net, part)[0])
            p *= (part != _PAD)[:, None, :]
            np.add.at(sums, np.array(owners)[owner[first : first + batch]], p.sum(axis=0).T)
    return sums / np.maximum(1, [len(t) for t in texts])[:, None]


def few_windows(text: bytes, windows: int, width: int = WINDOW) -> bytes:
    """`windows` windows of a text at most, chosen by its checksum and joined in their order: a text of those windows."""
    n = -(-len(text) // width)
    if n <= windows:
        return text
    chosen = np.sort(np.random.default_rng(zlib.crc32(text)).permutation(n)[:windows])
    return b"".join(text[k * width : (k + 1) * width] for k in chosen.tolist())


def train_language_id(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, languages: int = TRAIN_LANGUAGES, windows: int = TRAIN_WINDOWS, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Network:
    """Learned from text and non-null language of ids whose crc32 modulo 4 is not 2, about `per_language` of each.

    The choice goes by a hash of the id, and of a whole text `windows` windows are cut out in its task, so that the
    driver gets languages * per_language * windows * 128 bytes. Rows without id, text or language are not learned from.
    The `languages` most frequent names are learned. Without any such row the network knows no language.
    """
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (id_mod(F.col(id_col), 4) != 2))
    # A dirty column may hold any number of names; the most frequent ones are learned.
    named = known.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(languages)
    bounds = [(r["l"], rank_bound(per_language, r["n"])) for r in named.collect()]
    if not bounds:
        return train([], [])
    # One row a language.
    shares = docs.sparkSession.createDataFrame(bounds, "l string, bound bigint")
    rows = known.select(F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("binary").alias("t"), hash_rank(F.col(id_col), 13).alias("rank"))
    rows = rows.join(F.broadcast(shares), "l").filter("rank <= bound").select("l", "t")
    bounded_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([batch.column("l"), pa.array([few_windows(t, windows) for t in texts], pa.binary())], names=["l", "t"])

    got = sorted((r["l"], bytes(r["t"])) for r in rows.mapInArrow(cut, "l string, t binary").toLocalIterator())
    return train([t for _, t in got], [n for n, _ in got], windows=windows)


def has_letter(text: bytes) -> bool:
    """Whether the text, read as UTF-8, holds a character of a letter category."""
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def identify(docs: DataFrame, net: Network, carry: tuple[str, ...] | None = None, text_col: str = "text") -> DataFrame:
    """(doc, lang_pred, score) for every whole text, `doc` being the row or its columns `carry`.

    A null text, one without any letter, or any text when the network knows no language, is `und` with score 0.
    The score is the document's probability of the predicted language; ties go to the first language by name.
    """
    bounded_batches(docs.sparkSession)

    def load() -> Callable[[list[bytes]], pa.Array]:
        def work(texts: list[bytes]) -> pa.Array:
            found = [bool(net.languages) and has_letter(t) for t in texts]
            p = document_probabilities(net, [t if f else b"" for t, f in zip(texts, found, strict=True)])
            best = p.argmax(axis=1) if net.languages else np.zeros(len(texts), int)
            names = [net.languages[k] if f else UNDETERMINED for k, f in zip(best.tolist(), found, strict=True)]
            score = np.clip(np.where(found, p.max(axis=1, initial=0), 0.0), 0, 1)
            return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["lang_pred", "score"])

        return work

    found = per_text(F.col(text_col), "struct<lang_pred:string,score:double>", load)
    return docs.select(F.struct(*(carry or ["*"])).alias("doc"), found.alias("__found")).select("doc", "__found.lang_pred", "__found.score")
