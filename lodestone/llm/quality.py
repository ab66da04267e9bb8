"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import suppress
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, narrow, table

FOLDS, HELD_OUT = 3, 1
#: Labelled rows that the network is trained on, at most, the characters of each, and those of a piece: of a
#: longer text pieces from evenly spread places are learned from.
MAX_TRAIN, MAX_TRAIN_CHARS, PIECE = 3000, 20_000, 1000
#: Bytes that a filter sees, bytes from one position to the next, bytes of half a chunk. Two
#: neighbouring halves are a chunk, so chunks overlap by half and every byte lies in one.
WIDTH, STRIDE, HALF = 8, 2, 256
EMBED, FILTERS, HIDDEN = 6, 48, 24
#: Training steps, texts of a step, and the first rate.
STEPS, BATCH, RATE = 1200, 32, 4e-3
_POSITIONS = HALF // STRIDE
#: Positions that are convolved at once.
_BLOCK = 128 * _POSITIONS


@cache
def _one_thread() -> None:
    """Keeps OpenBLAS from starting threads: each task has a core of its own, and the products are
    small. Where the library isn't found, nothing changes but the speed."""
    with suppress(OSError), open("/proc/self/maps") as maps:
        for path in {line.split()[-1] for line in maps if "openblas" in line}:
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)


def padded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each filled with zeros to whole half-chunks, and each one's number of those.

    At least WIDTH zeros follow a text."""
    raw = [(t or "").encode() for t in texts]
    halves = np.array([(len(r) + WIDTH) // HALF + 1 for r in raw], np.int64)
    return np.frombuffer(b"".join(r.ljust(int(h) * HALF, b"\0") for r, h in zip(raw, halves, strict=True)) + bytes(WIDTH), np.uint8), halves


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH * EMBED x FILTERS
    bias: np.ndarray
    hidden: np.ndarray  # 2 * FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        draw = lambda n, *shape: (rng.standard_normal(shape) * np.sqrt(2 / n)).astype(np.float32)
        return Network(draw(2, 256, EMBED), draw(WIDTH * EMBED, WIDTH * EMBED, FILTERS), np.zeros(FILTERS, np.float32), draw(2 * FILTERS, 2 * FILTERS, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN, HIDDEN), np.zeros(1, np.float32))

    def pool_halves(self, data: np.ndarray, halves: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest response in each half-chunk, and at which position it is. The last
        positions of a text, from which a filter would see the next one, hold zeros and don't count."""
        ends = np.cumsum(halves) - 1
        n = (len(data) - WIDTH) // STRIDE
        most = np.empty((n // _POSITIONS, FILTERS), np.float32)
        at = np.empty(most.shape, np.int64) if where else None
        taps = self.filters.reshape(WIDTH // STRIDE, STRIDE * EMBED, FILTERS)
        for i in range(0, n, _BLOCK):
            m = min(_BLOCK, n - i)
            seen = self.embed[data[STRIDE * i : STRIDE * (i + m) + WIDTH - STRIDE]].reshape(-1, STRIDE * EMBED)
            r = seen[:m] @ taps[0]
            for k in range(1, len(taps)):
                r += seen[k : k + m] @ taps[k]
            r = r.reshape(-1, _POSITIONS, FILTERS)
            rows = slice(i // _POSITIONS, (i + m) // _POSITIONS)
            r[ends[(ends >= rows.start) & (ends < rows.stop)] - rows.start, 1 - len(taps) :] = -np.inf
            if where:
                at[rows] = r.argmax(1)
                most[rows] = np.take_along_axis(r, at[rows][:, None], 1)[:, 0]
            else:
                most[rows] = r.max(1)
        return np.maximum(most + self.bias, 0), at

    @staticmethod
    def combine(pooled: np.ndarray, halves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Chunks from pairs of half-chunks, and of each text the mean and the largest of its chunks.

        Gives these features, the chunks, each chunk's first half-chunk, and where texts' chunks start."""
        starts = np.concatenate(([0], np.cumsum(halves)[:-1]))
        count = np.maximum(halves - 1, 1)
        first = np.repeat(starts, count) + np.arange(count.sum()) - np.repeat(np.concatenate(([0], np.cumsum(count)[:-1])), count)
        second = np.where(np.repeat(halves, count) > 1, first + 1, first)
        chunks = np.maximum(pooled[first], pooled[second])
        at = np.concatenate(([0], np.cumsum(count)[:-1]))
        mean = np.add.reduceat(chunks, at, axis=0) / count[:, None].astype(np.float32)
        return np.concatenate((mean, np.maximum.reduceat(chunks, at, axis=0)), 1), chunks, first, at

    def head(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.hidden + self.hidden_bias, 0)
        return 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias, -30, 30))), h

    def scores(self, texts: list[str | None]) -> np.ndarray:
        data, halves = padded(texts)
        return self.head(self.combine(self.pool_halves(data, halves)[0], halves)[0])[0].astype(np.float64)

    def gradients(self, texts: list[str | None], y: np.ndarray) -> dict[str, np.ndarray]:
        data, halves = padded(texts)
        pooled, at = self.pool_halves(data, halves, where=True)
        x, chunks, first, start = self.combine(pooled, halves)
        p, h = self.head(x)
        dz = ((p - y) / len(y)).astype(np.float32)
        dh = dz[:, None] * self.out * (h > 0)
        dx = dh @ self.hidden.T
        count = np.diff(np.append(start, len(chunks)))
        text = np.repeat(np.arange(len(count)), count)
        dc = (dx[:, :FILTERS] / count[:, None])[text]
        top = chunks == x[text, FILTERS:]
        dc += np.where(top, dx[text, FILTERS:] / np.maximum(np.add.reduceat(top, start, axis=0, dtype=np.float32), 1)[text], 0)
        later = np.minimum(first + (halves[text] > 1), len(pooled) - 1)
        left = pooled[first] >= pooled[later]
        dp = np.zeros_like(pooled)
        np.add.at(dp, first, np.where(left, dc, 0))
        np.add.at(dp, later, np.where(left, 0, dc))
        dp *= pooled > 0
        seen = data[(np.arange(len(dp))[:, None] * HALF + at * STRIDE)[:, :, None] + np.arange(WIDTH)]
        filters = np.einsum("cf,cfk->kf", dp, self.embed[seen].reshape(*dp.shape, -1))
        to_embed = (dp[:, :, None] * self.filters.T).reshape(-1, EMBED)
        embed = np.stack([np.bincount(seen.reshape(-1), to_embed[:, k], 256) for k in range(EMBED)], 1).astype(np.float32)
        return {"embed": embed, "filters": filters, "bias": dp.sum(0), "hidden": x.T @ dh, "hidden_bias": dh.sum(0), "out": h.T @ dz, "out_bias": dz.sum(keepdims=True)}


def train(texts: list[str | None], y: list[int], steps: int | None = None, seed: int = 5) -> Network:
    """Adam, by default in STEPS steps, with a rate that falls to zero. Texts of like length share a batch; the order of the
    batches is drawn anew each time through. The same rows give the same network."""
    _one_thread()
    steps = STEPS if steps is None else steps
    rng = np.random.default_rng(seed)
    net, labels = Network.fresh(rng), np.array(y, np.float32)
    order = np.argsort([len(t or "") for t in texts], kind="stable")
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    t = 0
    while batches and t < steps:
        for k in rng.permutation(len(batches))[: steps - t]:
            t += 1
            for name, g in net.gradients([texts[i] for i in batches[k]], labels[batches[k]]).items():
                m, v = moments.get(name, (np.zeros_like(g), np.zeros_like(g)))
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                moments[name] = m, v
                step = RATE * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
                setattr(net, name, (getattr(net, name) - step).astype(np.float32))
    return net


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, max_chars: int = MAX_TRAIN_CHARS) -> Network:
    """A network from labels(doc_id, quality) whose fold is not 1 and their texts in docs(doc_id, text).

    Trains on the driver on at most max_train labelled ids, the first by a hash of the id, and one text of
    each, the greatest; of a text beyond max_chars characters on that many, in pieces spread evenly over
    all of it. So what is broadcast and collected is bounded. Rows with a null id or label, or a label
    other than 0 and 1, are left out; of an id's labels the greatest counts. Without any row the network
    is untrained."""
    own = narrow(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(fold("doc_id", FOLDS) != HELD_OUT)
    sample = own.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    n = max(1, max_chars // PIECE)
    pieces = F.expr(f"if(length(text) <= {max_chars}, text, array_join(transform(sequence(0, {n - 1}), i -> substring(text, cast(1 + i * (length(text) - {PIECE}) / {max(1, n - 1)} as int), {PIECE})), ''))")
    met = narrow(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", pieces.alias("text"), "label")
    rows = met.groupBy("doc_id").agg(F.max("text").alias("text"), F.first("label").alias("label")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or ""))
    return train([r.text for r in rows], [r.label for r in rows])


#: Characters that one forward pass takes.
_PASS = 1 << 20


def _scored(net: Network) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_thread()
        for b in batches:
            scores, texts, size = [], [], 0
            for t in b.column(1):
                texts.append(t.as_py())
                size += len(texts[-1] or "")
                if size > _PASS:
                    scores.append(net.scores(texts))
                    texts, size = [], 0
            if texts:
                scores.append(net.scores(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0))], ["doc_id", "score"])

    return run


def quality(docs: DataFrame, net: Network) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, held_out, score, predicted.

    held_out: the id's fold is 1, so no label of it was learned from; null for a null id. Scores come
    from whole texts alone: every byte lies in a chunk. Null and empty texts are scored as one chunk
    of padding. Equal scores need no order. Repeated rows repeat; empty tables give no rows; other
    columns are not read, whatever their names."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = narrow(docs, "doc_id", "text").mapInArrow(_scored(net), f"doc_id {kind}, score double")
    return out.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quality over documents, by a network learned from labels whose fold is not 1."""
    docs = table(spark, sf_dir, "documents")
    return quality(docs, learn(docs, table(spark, sf_dir, "labels")))
