"""Quality classifier: random-indexing word vectors, pooled per text, and a two-layer network.

Each vocabulary word has a sparse random index vector, a function of the word. Its
word vector is the sum of the index vectors of its neighbours over the whole corpus.
A text is pooled to the mean and spread of its words' vectors with four plain
figures; a small numpy network turns that into a probability, calibrated by a
temperature on rows kept aside.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placemill.llm.common import count_of_most, stored
from placemill.llm.labelled import labelled_sample

# Case stays: shouting is a sign of its own.
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
DIM = 64
ONES = 4
REACH = 2
VOCABULARY = 8192
SAMPLE = 20_000
FLUSH = 300_000
EXTRA = 4


def index_vectors(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, k) places and signs of the ones in each word's index vector, from its hash alone."""
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=np.uint64).reshape(-1, 1)
    shifts = np.arange(ONES, dtype=np.uint64) * np.uint64(8)
    places = ((h >> shifts) & np.uint64(DIM - 1)).astype(np.int64)
    signs = 1 - 2 * ((h >> (shifts + np.uint64(32))) & np.uint64(1)).astype(np.int64)
    return places, signs


def vocabulary(docs: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The most frequent tokens of the whole corpus, at most ``most`` and 40 letters long each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(TOKEN.findall(text.as_py()))
                if len(seen) >= FLUSH:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                    seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    parts = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "word string, n bigint")
    words = stored(parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") <= 40), "tokens")
    threshold = count_of_most(words, "n", most)
    return sorted(r["word"] for r in words.where(F.col("n") >= threshold).select("word").collect())


def word_vectors(docs: DataFrame, words: list[str]) -> np.ndarray:
    """(word, dimension): summed index vectors of the neighbours within two tokens, centred and scaled to length 1.

    A task returns one vector for each word at most; sums are of whole numbers, so
    their order does not matter.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)
    size = len(words)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        index = {w: i for i, w in enumerate(words)}
        places, signs = index_vectors(words)
        total = np.zeros(size * DIM)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                ids: list[int] = []
                for text in batch.column(0).slice(low, 500):
                    ids += [index.get(t, -1) for t in TOKEN.findall(text.as_py())]
                    ids += [-1] * REACH
                flat = np.array(ids, dtype=np.int64)
                for o in range(1, REACH + 1):
                    a, b = flat[:-o], flat[o:]
                    both = (a >= 0) & (b >= 0)
                    a, b = a[both], b[both]
                    for k in range(ONES):
                        total += np.bincount(a * DIM + places[b, k], weights=signs[b, k], minlength=size * DIM)
                        total += np.bincount(b * DIM + places[a, k], weights=signs[a, k], minlength=size * DIM)
        sums = total.reshape(size, DIM)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *(pa.array(sums[used, d].astype(np.int64)) for d in range(DIM))], names=["w", *(f"d{d}" for d in range(DIM))])

    out = np.zeros((size, DIM))
    if size:
        texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
        parts = texts.mapInArrow(neighbours, "w bigint, " + ", ".join(f"d{d} bigint" for d in range(DIM)))
        got = parts.groupBy("w").agg(*(F.sum(f"d{d}").alias(f"d{d}") for d in range(DIM))).toPandas()
        out[got["w"].to_numpy(dtype=np.int64)] = got[[f"d{d}" for d in range(DIM)]].to_numpy(dtype=np.float64)
        out = np.sign(out) * np.log1p(np.abs(out))
        out -= out.mean(axis=0)
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


class Pooling:
    def __init__(self, words: list[str], vectors: np.ndarray):
        self.index = {w: i for i, w in enumerate(words)}
        self.vectors = np.vstack([vectors, np.zeros((1, DIM))]).astype(np.float32)

    def of(self, text: str) -> np.ndarray:
        """Mean and spread of the known words' vectors, shares of unknown and of distinct tokens, length, mean token length."""
        all_ = TOKEN.findall(text)
        out = np.zeros(2 * DIM + EXTRA, np.float32)
        if not all_:
            return out
        get = self.index.get
        ids = np.array([get(t, -1) for t in all_], dtype=np.int64)
        known = ids[ids >= 0]
        if known.size:
            counts = np.bincount(known)
            used = np.flatnonzero(counts)
            share = counts[used] / known.size
            v = self.vectors[used]
            mean = share @ v
            out[:DIM] = mean
            out[DIM : 2 * DIM] = np.sqrt(np.maximum(share @ (v * v) - mean * mean, 0))
        n = len(all_)
        out[2 * DIM :] = [1 - known.size / n, len(set(all_)) / n, np.log1p(n), sum(map(len, all_)) / n / 10]
        return out


@dataclass
class Network:
    """Standardise, one hidden layer, one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _loss(logit: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logit) - y * logit))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5, decay: float = 1e-3) -> Network:
    """Adam on four fifths of the rows, temperature on the rest. With no rows, or one label, all scores are that label's share."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(d), np.ones(d))
    share = (y.sum() + 0.5) / (len(y) + 1)
    net = Network(mean, scale, np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return net
    order = rng.permutation(len(x))
    held, train = order[: len(x) // 5], order[len(x) // 5 :]
    net.w1, net.w2 = rng.normal(0, 1 / np.sqrt(d), (d, hidden)), rng.normal(0, 1 / np.sqrt(hidden), hidden)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        for low in range(0, len(train), 256):
            rows = train[low : low + 256]
            h = np.tanh(z[rows] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[rows].T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            step += 1
            for i, grad in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        train = rng.permutation(train)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    if len(held) and len(np.unique(y[held])) == 2:
        logit = net.logits(x[held])
        tries = np.exp(np.linspace(np.log(0.3), np.log(8), 60))
        net.temperature = float(tries[int(np.argmin([_loss(logit / t, y[held]) for t in tries]))])
    return net


def _pooled(rows: DataFrame, words: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample, which is bounded, on the driver."""
    shared = rows.sparkSession.sparkContext.broadcast((words, vectors))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pooling = Pooling(*shared.value)
        for batch in batches:
            made = [pooling.of(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["doc_id", "label", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "label").mapInArrow(pool, f"doc_id {kind}, label double, x binary").orderBy("doc_id", "x").toPandas()
    x = np.frombuffer(b"".join(map(bytes, got["x"])), dtype=np.float32).reshape(len(got), 2 * DIM + EXTRA).astype(np.float64)
    return x, got["label"].to_numpy(dtype=np.float64)


def _scored(docs: DataFrame, labels: DataFrame, sample: int, carried) -> DataFrame:
    """(carried, score) for every row of ``docs``."""
    words = vocabulary(docs)
    vectors = word_vectors(docs, words)
    x, y = _pooled(labelled_sample(docs, labels, "quality", sample), words, vectors)
    shared = docs.sparkSession.sparkContext.broadcast((words, vectors, fit_network(x, y)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, vectors, net = shared.value
        pooling = Pooling(words, vectors)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                x = np.stack([pooling.of(t.as_py() or "") for t in part.column(1)]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(net.scores(x))], names=["carried", "score"])

    rows = docs.select(carried.alias("carried"), "text")
    return rows.mapInArrow(score, T.StructType([rows.schema["carried"], T.StructField("score", T.DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score): the probability that a text's label is 1, for every row of ``docs``.

    Vocabulary and word vectors come from all of ``docs``; the network is fitted to
    at most ``sample`` labelled rows (see ``labelled_sample``). Only the text is an
    input of a score. A null or blank text is scored too, by the features of no
    words; rows stay as they are, repeated and without an id; an empty table gives
    no rows, and without labels every text scores one half. Other columns are dropped.
    """
    return _scored(docs, labels, sample, F.col("doc_id")).withColumnRenamed("carried", "doc_id")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns."""
    return _scored(docs, labels, sample, F.struct("*")).where(F.col("score") >= least).select("carried.*")
