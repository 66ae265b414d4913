"""Subword lattice likelihood: the probability of a text summed over all its segmentations.

A text is read as words and one end. Every way of cutting a word into vocabulary
pieces is weighted by the product of the pieces' scores; a forward recursion in
log space sums them. Words are cut apart by white space, so a text's log
probability is the sum of its words' and the end's, and each distinct word of the
corpus is summed once. Scores are one unigram table (piece, log probability) over
an existing vocabulary; ``learn_scores`` fits one to a corpus by expected counts. Words
learnt from add one arc each over the whole word (``WordArcs``), so the sum also runs
over "the word as such" beside its cuts into pieces.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.llm.bpe import END, byte_letters
from placemill.llm.common import ROW, count_of_most, stored

# A byte no UTF-8 text holds marks the end of a word.
STOP = b"\xff"
FLUSH = 300_000
CHUNK = 40_000


def pieces_of(path: str) -> list[bytes]:
    """Pieces of a tokenizer file in order of rank, as bytes, a word's end as STOP."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    out = []
    for token in sorted(vocabulary, key=vocabulary.get):
        body = token.removesuffix(END)
        out.append(bytes(byte_of[c] for c in body) + (STOP if token.endswith(END) else b""))
    return out


def first_scores(pieces: list[bytes]) -> np.ndarray:
    """Scores to begin with, from the order of the vocabulary alone: p falls as 1 / rank, single bytes last."""
    rank = np.arange(1, len(pieces) + 1, dtype=np.float64)
    single = np.array([len(p.removesuffix(STOP)) == 1 for p in pieces])
    rank[single] = len(pieces)
    p = 1 / rank
    return np.log(p / p.sum())


class Lattice:
    """Edges and sums for batches of words; all pieces are found by rolling hashes of their prefixes."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[bytes]):
        table: dict[int, int] = {}
        mask, base = (1 << 64) - 1, int(self.BASE)
        for i, piece in enumerate(pieces):
            h = 0
            for n, b in enumerate(piece, 1):
                h = (h * base + b + 1) & mask
                table[h] = i if n == len(piece) else table.get(h, -1)
        self.longest = max(map(len, pieces), default=1)
        self.size = len(pieces)
        bits = max(4, (len(table) * 8).bit_length())
        self.shift = np.uint64(64 - bits)
        self.spread = np.uint64(0xD6E8FEB86659FD93)
        self.keys, self.values = np.zeros((1 << bits) + 64, np.uint64), np.full((1 << bits) + 64, -2, np.int32)
        for h, i in table.items():
            at = ((h * int(self.spread)) & mask) >> int(self.shift)
            step = 0
            while self.values[at + step] != -2:
                step += 1
            self.keys[at + step], self.values[at + step] = h, i

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash; -1 for a mere prefix of pieces, -2 for neither."""
        at = ((h * self.spread) >> self.shift).astype(np.int64)
        out = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != h) & (out != -2))
        out[open_] = -2
        at, h = at[open_], h[open_]
        while open_.size:
            at = at + 1
            got, same = self.values[at], self.keys[at] == h
            out[open_[same]] = got[same]
            on = ~same & (got != -2)
            open_, at, h = open_[on], at[on], h[on]
        return out

    def _layers(self, words: list[bytes]) -> tuple[int, list[tuple[int, np.ndarray]]]:
        """For words of one length: that length with the stop, and for each piece length n
        a matrix (start, word) of the piece that begins there, -1 for none."""
        width, count = len(words[0]) + 1, len(words)
        letters = np.frombuffer(STOP.join(words) + STOP, dtype=np.uint8).reshape(count, width).T
        flat = letters.astype(np.uint64).ravel() + np.uint64(1)
        starts, h, layers = np.arange(flat.size), np.zeros(flat.size, np.uint64), []
        for n in range(1, min(self.longest, width) + 1):
            fits = np.searchsorted(starts, (width - n + 1) * count)
            starts, h = starts[:fits], h[:fits]
            if not starts.size:
                break
            h = h * self.BASE + flat[starts + (n - 1) * count]
            piece = self._find(h)
            hit = piece >= 0
            if hit.any():
                layer = np.full((width - n + 1) * count, -1, np.int32)
                layer[starts[hit]] = piece[hit]
                layers.append((n, layer.reshape(width - n + 1, count)))
            on = piece > -2
            starts, h = starts[on], h[on]
        return width, layers

    @staticmethod
    def _log_sum(terms: list[np.ndarray]) -> np.ndarray:
        stack = np.stack(terms)
        top = stack.max(axis=0)
        safe = np.where(np.isfinite(top), top, 0.0)
        with np.errstate(divide="ignore"):
            return safe + np.log(np.exp(stack - safe).sum(axis=0))

    def _ahead(self, width: int, weights: list[tuple[int, np.ndarray]], count: int) -> np.ndarray:
        """Log sums over all paths from the word's start to each position."""
        total = np.full((width + 1, count), -np.inf)
        total[0] = 0.0
        for end in range(1, width + 1):
            if terms := [total[end - n] + w[end - n] for n, w in weights if n <= end]:
                total[end] = self._log_sum(terms)
        return total

    def _back(self, width: int, weights: list[tuple[int, np.ndarray]], count: int) -> np.ndarray:
        """Log sums over all paths from each position to the word's end."""
        total = np.full((width + 1, count), -np.inf)
        total[width] = 0.0
        for start in range(width - 1, -1, -1):
            if terms := [w[start] + total[start + n] for n, w in weights if start + n <= width]:
                total[start] = self._log_sum(terms)
        return total

    def _by_length(self, words: list[bytes]) -> Iterator[np.ndarray]:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(lengths, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            for low in range(0, group.size, max(1, 400_000 // (int(lengths[group[0]]) + 1))):
                yield group[low : low + max(1, 400_000 // (int(lengths[group[0]]) + 1))]

    @staticmethod
    def _weights(layers: list[tuple[int, np.ndarray]], scores: np.ndarray) -> list[tuple[int, np.ndarray]]:
        return [(n, np.where(layer >= 0, scores[layer], -np.inf)) for n, layer in layers]

    def forward(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Natural log of the summed probability of each word, its end included."""
        out = np.zeros(len(words))
        for group in self._by_length(words) if words else ():
            width, layers = self._layers([words[i] for i in group])
            out[group] = self._ahead(width, self._weights(layers, scores), group.size)[width]
        return out

    def expected(self, words: list[bytes], scores: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece over all segmentations, each word once."""
        out = np.zeros(self.size)
        for group in self._by_length(words) if words else ():
            width, layers = self._layers([words[i] for i in group])
            weights = self._weights(layers, scores)
            ahead, back = self._ahead(width, weights, group.size), self._back(width, weights, group.size)
            for (n, layer), (_, w) in zip(layers, weights):
                hit = layer >= 0
                with np.errstate(invalid="ignore"):
                    share = np.exp((ahead[: width - n + 1] + w + back[n:] - ahead[width])[hit])
                out += np.bincount(layer[hit], weights=np.nan_to_num(share), minlength=self.size)
        return out


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together to about CHUNK rows, so that words of one length come in numbers."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def tokens(text: str) -> list[bytes]:
    """Words in A-Z lower case. Bytes split at the six ASCII spaces only, as the token pattern does."""
    return text.encode().lower().split()


def word_table(docs: DataFrame, learn: Column) -> DataFrame:
    """(word, n, n_learn): every distinct word of the corpus, its count in all texts and in those learnt from."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, learnt = Counter(), Counter()

        def out() -> pa.RecordBatch:
            words = list(seen)
            n_learn = [learnt[w] for w in words]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array(n_learn, pa.int64())], names=["word", "n", "n_learn"])
            seen.clear()
            learnt.clear()
            return batch

        for batch in batches:
            for text, use in zip(batch.column(0), batch.column(1).to_pylist()):
                words = tokens(text.as_py())
                seen.update(words)
                if use:
                    learnt.update(words)
                if len(seen) >= FLUSH:
                    yield out()
        if seen:
            yield out()

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    parts = rows.mapInArrow(count, "word binary, n bigint, n_learn bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_learn").alias("n_learn"))


def learn_scores(words: DataFrame, pieces: list[bytes], rounds: int = 3, smooth: float = 0.1) -> np.ndarray:
    """Natural log scores of the pieces, fitted to the distinct words learnt from.

    Each round sums the pieces' expected counts over the whole word table, every
    distinct word once: the pieces are there for words seen seldom or never. A task
    returns one number per piece at most, so what meets is bounded by the vocabulary.
    """
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(pieces)
    scores = first_scores(pieces)
    known = words.where("n_learn > 0").select("word")
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(scores)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, sums = _lattice(shared.value), np.zeros(len(shared.value))
            for part in in_chunks(batches):
                sums += lattice.expected(part.column(0).to_pylist(), now.value)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(sums[used])], names=["piece", "n"])

        got = known.mapInArrow(expect, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        sums = np.full(len(pieces), smooth)
        sums[got["piece"].to_numpy(dtype=np.int64)] += got["n"].to_numpy(dtype=np.float64)
        scores = np.log(sums / sums.sum())
    return scores


class WordArcs:
    """Arcs over whole words learnt from, discounted; what they leave goes to the paths over pieces.

    The discount comes from the words seen once and twice. With the end's share the
    probabilities of all words and the end add up to one.
    """

    def __init__(self, words: DataFrame, ends: int):
        once, twice, distinct, total = words.agg(
            F.count_if(F.col("n_learn") == 1), F.count_if(F.col("n_learn") == 2), F.count_if(F.col("n_learn") > 0), F.coalesce(F.sum("n_learn"), F.lit(0))
        ).first()
        self.total, self.distinct = total + ends, distinct + (ends > 0)
        self.discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        self.end = math.log((ends + 0.5) / (self.total + 1))
        self.rest = math.log((self.discount * distinct + 0.5) / (self.total + 1))

    def add(self, paths: np.ndarray, learnt: np.ndarray) -> np.ndarray:
        """Log probability of words from the sums over their pieces and their counts."""
        with np.errstate(divide="ignore"):
            arc = np.log(np.maximum(learnt - self.discount, 0.0) / (self.total + 1))
        return np.logaddexp(arc, self.rest + paths)


_LATTICES: dict[int, Lattice] = {}


def _lattice(pieces: list[bytes]) -> Lattice:
    """The lattice tables of a vocabulary, built once in a worker."""
    key = hash(tuple(pieces))
    if key not in _LATTICES:
        _LATTICES.clear()
        _LATTICES[key] = Lattice(pieces)
    return _LATTICES[key]


def word_scores(words: DataFrame, pieces: list[bytes], scores: np.ndarray, arcs: WordArcs) -> DataFrame:
    """The word table with ``lp``, the natural log of each word's summed probability."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, scores, arcs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, scores, arcs = shared.value
        lattice = _lattice(pieces)
        for part in in_chunks(batches):
            lp = arcs.add(lattice.forward(part.column(0).to_pylist(), scores), part.column(2).to_numpy())
            yield from part.append_column("lp", pa.array(lp)).to_batches()

    return words.select("word", "n", "n_learn").mapInArrow(score, "word binary, n bigint, n_learn bigint, lp double")


def score_documents(docs: DataFrame, path: str, learn: Column, rounds: int = 3, common: int = 200_000) -> DataFrame:
    """(doc_id, learnt, n_tokens, n_known, train_tokens, base_score, score): log10 probability of every whole text.

    ``learn`` marks the rows whose words are learnt from; ``path`` names the
    tokenizer file whose pieces are scored; ``base_score`` is the smoothed count
    of whole words. The ``common`` most frequent words, 64 bytes long at most, are
    broadcast with their scores; all other words go to the word table by a shuffle
    and come back as sums per row, so neither way grows with one document or word.
    A null text counts as empty and scores its end alone; a null id is kept; rows
    with the same id are scored one by one; an empty table gives no rows. Other
    columns are dropped.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("_learn"))
    pieces = pieces_of(path)
    words = stored(word_table(docs, F.col("_learn")), "words")
    ends = docs.where("_learn").count()
    arcs = WordArcs(words, ends)
    n, distinct, end = arcs.total, arcs.distinct, arcs.end
    scores = learn_scores(words, pieces, rounds)
    scored = stored(word_scores(words, pieces, scores, arcs), "word-scores")
    threshold = count_of_most(scored, "n", common)
    often = scored.where((F.col("n") >= threshold) & (F.length("word") <= 64)).select("word", "n_learn", "lp").collect()
    often = ([bytes(r["word"]) for r in often], np.array([r["n_learn"] for r in often], np.float64), np.array([r["lp"] for r in often], np.float64))
    shared = spark.sparkContext.broadcast(often)
    below = math.log10(0.1 * (distinct + 1) + n)

    def base(count):
        return np.log10(count + 0.1) - below

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, learnt, lp = shared.value
        index = {w: i for i, w in enumerate(words)}
        at_base, at_lp, at_known = np.append(base(learnt), 0.0), np.append(lp, 0.0), np.append(learnt > 0, False)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                out: list[tuple] = []
                for row, doc, use, text in zip(*(part.column(i).to_pylist() for i in range(3)), part.column(3)):
                    all_ = tokens(text.as_py())
                    ids = np.fromiter((index.get(w, -1) for w in all_), dtype=np.int64, count=len(all_))
                    # A row's own key holds a space, so no word meets it.
                    out.append((row, doc, use, b" %d" % row, 0, len(all_) + 1, int(at_known[ids].sum()) + (ends > 0), float(at_base[ids].sum() + base(ends)), float(at_lp[ids].sum() + end)))
                    rare = Counter([all_[i] for i in np.flatnonzero(ids < 0)])
                    out += [(row, None, None, w, k, 0, 0, 0.0, 0.0) for w, k in rare.items()]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), fields)], schema=pa.schema(fields))

    rows = docs.select(F.monotonically_increasing_id().alias(ROW), "doc_id", F.col("_learn").alias("learnt"), F.coalesce("text", F.lit("")).alias("text"))
    id_type = pa.from_numpy_dtype(np.int64) if rows.schema["doc_id"].dataType.simpleString() == "bigint" else pa.string()
    if id_type == pa.string():
        rows = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    fields = [pa.field(ROW, pa.int64()), pa.field("doc_id", id_type), pa.field("learnt", pa.bool_()), pa.field("word", pa.binary()), pa.field("k", pa.int64()),
              pa.field("n_tokens", pa.int64()), pa.field("n_known", pa.int64()), pa.field("base", pa.float64()), pa.field("lp", pa.float64())]
    kind = rows.schema["doc_id"].dataType.simpleString()
    parts = rows.mapInArrow(split, f"{ROW} bigint, doc_id {kind}, learnt boolean, word binary, k bigint, n_tokens bigint, n_known bigint, base double, lp double")
    looked_up = scored.select("word", F.col("n_learn").alias("c"), F.col("lp").alias("word_lp"))
    joined = parts.join(looked_up, "word", "left").select(
        ROW, "doc_id", "learnt", "n_tokens",
        (F.col("n_known") + F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.when(F.col("k") > 0, F.col("k") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - below)).otherwise(0.0)).alias("base"),
        (F.col("lp") + F.when(F.col("k") > 0, F.col("k") * F.col("word_lp")).otherwise(0.0)).alias("lp"),
    )
    return joined.groupBy(ROW).agg(
        F.max("doc_id").alias("doc_id"), F.max("learnt").alias("learnt"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"), F.sum("base").alias("base_score"), (F.sum("lp") / math.log(10)).alias("score"),
    ).drop(ROW)
