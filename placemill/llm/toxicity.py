"""Toxicity classifier, regularised with counterfactuals.

A linear model over the words present in a text. Labelled texts that name a group
of people are also taken with the group's name swapped for others of its kind, the
name's beginnings with it; the loss adds the squared change of the score between a
text and its swaps, so that naming a group as such moves no score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import stored
from placemill.llm.labelled import labelled_sample
from placemill.llm.near_copies import gram_hashes

WORD = re.compile(r"[^\W\d_]+")
SAMPLE = 20_000
WORDS = 3000
STEMS = (3, 4, 5, 6)
FLUSH = 300_000

# Names of groups, by kind. Within a kind each may stand for another.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "bisexual", "straight", "transgender", "queer"),
    ("black", "white", "asian", "latino", "hispanic", "indigenous"),
    ("immigrants", "refugees", "foreigners", "migrants", "natives", "citizens"),
    ("african", "european", "american", "mexican", "chinese", "indian", "arab", "turkish", "polish", "russian"),
    ("blind", "deaf", "disabled", "autistic"),
    ("old", "young", "elderly", "teenage"),
    ("frauen", "männer", "muslime", "christen", "juden", "ausländer", "flüchtlinge"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs", "étrangers", "réfugiés"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos", "extranjeros", "refugiados"),
)


def words_in(text: str) -> set[str]:
    """The words present, and their beginnings of three to six letters (marked ``*``), for languages that put endings on words."""
    return with_beginnings(set(WORD.findall(text.lower())))


def with_beginnings(words: set[str]) -> set[str]:
    return words.union(*[[w[:n] + "*" for w in words if len(w) > n] for n in STEMS])


def one_of_copies(sample: DataFrame) -> DataFrame:
    """The sample with one text for each label and MinHash of five-word n-grams, so that near copies teach once, not as often as they lie about."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(g.min()) >> 1 if (g := gram_hashes(t.as_py())).size else -1 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["doc_id", "text", "label", "key"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    keyed = sample.select("doc_id", "text", "label").mapInArrow(key, f"doc_id {kind}, text string, label double, key bigint")
    first = keyed.groupBy("key", "label").agg(F.min(F.struct("doc_id", "text")).alias("r"))
    return stored(first.select("r.doc_id", "r.text", "label"), "labelled")


def telling_words(sample: DataFrame, most: int = WORDS, least: float = 3.0) -> list[str]:
    """The words whose presence tells the labels apart, at most ``most``; all identity terms come besides.

    Per word the number of clean and of toxic texts is summed. Ranked by |log odds
    ratio| over its standard error, of which there must be ``least``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            words = list(seen[0] | seen[1])
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in seen)], names=["word", "clean", "toxic"])
            seen[0].clear()
            seen[1].clear()
            return batch

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[int(label >= 0.5)].update(words_in(text.as_py()))
                if len(seen[0]) + len(seen[1]) >= FLUSH:
                    yield out()
        if seen[0] or seen[1]:
            yield out()

    counts = sample.select("text", "label").mapInArrow(count, "word string, clean bigint, toxic bigint").groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n = sample.agg(F.count_if(F.col("label") < 0.5).alias("clean"), F.count_if(F.col("label") >= 0.5).alias("toxic")).first()
    counts = counts.where((F.col("clean") + F.col("toxic") > 1) & (F.length("word") <= 64))
    a, b, c, d = F.col("toxic") + 0.5, F.lit(n["toxic"] + 0.5) - F.col("toxic"), F.col("clean") + 0.5, F.lit(n["clean"] + 0.5) - F.col("clean")
    strength = F.abs(F.log(a * d / (b * c))) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    best = [r["word"] for r in counts.withColumn("z", strength).where(F.col("z") >= least).orderBy(F.desc("z"), "word").limit(most).collect()]
    return best + sorted({w for kind in IDENTITY_TERMS for w in kind} - set(best))


class LinearModel:
    def __init__(self, words: list[str], weights: np.ndarray, bias: float):
        self.index = {w: i for i, w in enumerate(words)}
        self.weights, self.bias = weights, bias

    def present(self, text: str) -> list[int]:
        get = self.index.get
        return [i for w in words_in(text) if (i := get(w)) is not None]

    def score(self, text: str) -> float:
        z = self.bias + float(self.weights[self.present(text)].sum())
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def swaps(words: set[str], index: dict[str, int]) -> list[list[int]]:
    """For each kind of group named and each other name of the kind: what changes when it replaces the text's names.

    ``words`` are all whole words of the text. i + 1 stands for a feature i that comes,
    -(i + 1) for one that goes; beginnings that other words bring as well stay.
    """
    out = []
    for kind in IDENTITY_TERMS:
        names = [w for w in kind if w in index]
        named = words.intersection(names)
        if named:
            rest, old = with_beginnings(words - named), with_beginnings(named)
            for other in names:
                if {other} != named:
                    new = with_beginnings({other})
                    out.append([index[w] + 1 for w in sorted(new - old - rest) if w in index] + [-index[w] - 1 for w in sorted(old - new - rest) if w in index])
    return out


def fit(rows: list[tuple[list[int], float]], words: list[str], evenness: float = 1.0, decay: float = 2e-5, steps: int = 250, changes: list[list[list[int]]] | None = None) -> LinearModel:
    """Logistic loss, plus ``evenness`` times the mean squared change of the logit under swaps, plus weight decay; Adam.

    ``changes`` are the ``swaps`` of each row's text; without them those of its known words are taken.
    """
    size = len(words)
    index = {w: i for i, w in enumerate(words)}
    y = np.array([label for _, label in rows])
    share = (y.sum() + 0.5) / (len(y) + 1)
    weights, bias = np.zeros(size), float(np.log(share / (1 - share)))
    if len(np.unique(y)) < 2:
        return LinearModel(words, weights, bias)
    flat = np.array([i for ids, _ in rows for i in ids], dtype=np.int64)
    who = np.repeat(np.arange(len(rows)), [len(ids) for ids, _ in rows])
    # A swap's change of score is the sum of a few weights: those that come less those that go.
    if changes is None:
        changes = [swaps({words[i] for i in ids}, index) for ids, _ in rows]
    moved = [c for row in changes for c in row]
    pairs = len(moved)
    signed = np.array([i for c in moved for i in c], dtype=np.int64)
    d_flat, d_sign, d_who = np.abs(signed) - 1, np.sign(signed).astype(float), np.repeat(np.arange(pairs), [len(c) for c in moved])
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(who, weights=weights[flat], minlength=len(rows)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        grad = np.bincount(flat, weights=g[who], minlength=size) + decay * weights
        if pairs:
            change = np.bincount(d_who, weights=d_sign * weights[d_flat], minlength=pairs)
            grad += evenness * 2 / pairs * np.bincount(d_flat, weights=d_sign * change[d_who], minlength=size)
        grad = np.append(grad, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9) * (1 - 0.9 * step / steps)
        weights, bias = weights - move[:-1], bias - move[-1]
    return LinearModel(words, weights, float(bias))


def toxicity_model(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, evenness: float = 1.0) -> LinearModel:
    rows = one_of_copies(labelled_sample(docs, labels, "toxic", sample))
    words = telling_words(rows)
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LinearModel(shared.value, np.zeros(0), 0.0)
        for batch in batches:
            ids = [np.array(sorted(model.present(t.as_py())), dtype=np.int32).tobytes() for t in batch.column(1)]
            changes = [swaps(set(WORD.findall(t.as_py().lower())), model.index) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ids, pa.binary()), pa.array(changes, pa.list_(pa.list_(pa.int32())))], names=["doc_id", "label", "ids", "changes"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = rows.select("doc_id", "text", "label").mapInArrow(present, f"doc_id {kind}, label double, ids binary, changes array<array<int>>").orderBy("doc_id", "ids", "changes").toArrow()
    fitted = [(np.frombuffer(b, dtype=np.int32).tolist(), float(y)) for b, y in zip(got["ids"].to_pylist(), got["label"].to_pylist())]
    return fit(fitted, words, evenness, changes=got["changes"].to_pylist())


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, evenness: float = 1.0) -> DataFrame:
    """(doc_id, score): the probability that a text's label is 1, for every row of ``docs``.

    The model is fitted to at most ``sample`` labelled rows (see ``labelled_sample``)
    and scores whole texts; only the text is an input. A null or empty text gets the
    score of no words; rows stay as they are, repeated and without an id; an empty
    table gives no rows, and without labels every text scores one half. Other
    columns are dropped.
    """
    shared = docs.sparkSession.sparkContext.broadcast(toxicity_model(docs, labels, sample, evenness))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.score(t.as_py() or "") for t in part.column(1)])], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {kind}, score double")
