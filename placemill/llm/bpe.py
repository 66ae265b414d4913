"""BPE encoding and decoding with an automaton compiled from the merges.

The automaton reads tokens. A path from the start spells the tokenization of a
word exactly if every arc on it exists, and each prefix of a word has one such
path. It is built merge by merge: the gadget of a merge (u, v) adds the state uv,
which takes over u's incoming arcs and v's outgoing arcs as they stand, and then
cuts the arc from u to v. A gadget is kept as three numbers (whose arcs come in,
whose go out, when), so the 49,000 states of a public vocabulary take a few
megabytes; the arc between two states follows from the gadgets that made them and
is entered in the transition table when first used.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.llm.common import texts

END = "</w>"
HEAD = 4
# Bounds of what a worker remembers; beyond them it forgets and goes on.
TABLE_MOST = 1_000_000
WORDS_MOST = 600_000

# Fixed values of the vocabulary's format: special tokens' ids aside, how a text is cut before merging.
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next free one from 256 on."""
    spare = iter(range(256, 512))
    return [chr(b) if b in PRINTABLE else chr(next(spare)) for b in range(256)]


class MergeAutomaton:
    """States are tokens (by id), plus the start, from which every token may be read."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values(), default=-1) + 1
        self.labels = [""] * size
        for token, i in vocabulary.items():
            self.labels[i] = token
        self.arcs_in, self.arcs_out, self.born = list(range(size)), list(range(size)), [-1] * size
        self.cut: dict[int, int] = {}
        self.size = size
        for time, (u, v) in enumerate(merges):
            self._gadget(vocabulary[u], vocabulary[v], vocabulary[u + v], time)
        self.inner = {t: i for t, i in vocabulary.items() if not t.endswith(END)}
        self.final = {t[: -len(END)]: i for t, i in vocabulary.items() if t.endswith(END)}
        # How long a label beginning with these letters can be.
        self.reach: dict[str, int] = {}
        for label in [*self.inner, *self.final]:
            self.reach[label[:HEAD]] = max(len(label), self.reach.get(label[:HEAD], 0))
        self.table: dict[int, bool] = {}

    def _gadget(self, u: int, v: int, uv: int, time: int) -> None:
        self.arcs_in[uv], self.arcs_out[uv], self.born[uv] = u, v, time
        self.cut[u * self.size + v] = time

    def has_arc(self, p: int, t: int) -> bool:
        """Whether token t may be read in the state that p leads to."""
        key = p * self.size + t
        known = self.table.get(key)
        if known is None:
            if len(self.table) >= TABLE_MOST:
                self.table.clear()
            known = self.table[key] = self._arc(p, t)
        return known

    def _arc(self, p: int, t: int) -> bool:
        born, size = self.born, self.size
        now = len(self.cut) + 1
        while True:
            if self.cut.get(p * size + t, now) < now:
                return False
            if born[p] < 0 and born[t] < 0:
                return True
            # The younger state's gadget copied this arc from an older pair, as it stood then.
            if born[p] > born[t]:
                now, p = born[p], self.arcs_out[p]
            elif born[t] > born[p]:
                if self.arcs_in[t] == self.arcs_out[t] == p:  # of three equal tokens the left two merge
                    return False
                now, t = born[t], self.arcs_in[t]
            else:
                now, p, t = born[p], self.arcs_out[p], self.arcs_in[t]

    def encode(self, word: str) -> list[int]:
        """Token ids of one pre-split word, in byte letters: longest label first, back where no arc leads on.

        A position is reached by one path only, so a position without a way on is
        dead for good and is entered once.
        """
        n, pos, path, steps, dead = len(word), 0, [], [], set()
        inner, final, reach, table, size = self.inner, self.final, self.reach, self.table, self.size
        state, length = -1, -1
        while pos < n:
            if length < 0:
                length = min(n - pos, reach.get(word[pos : pos + HEAD], HEAD - 1))
            while length:
                end = pos + length
                token = final.get(word[pos:]) if end == n else inner.get(word[pos:end])
                if token is not None and end not in dead:
                    if state < 0:
                        break
                    known = table.get(state * size + token)
                    if known or known is None and self.has_arc(state, token):
                        break
                length -= 1
            if length:
                steps.append((pos, length))
                path.append(token)
                pos, state, length = end, token, -1
            elif not steps:
                raise ValueError(f"no path for {word!r}")
            else:
                dead.add(pos)
                path.pop()
                pos, length = steps.pop()
                length -= 1
                state = path[-1] if path else -1
        return path


class WordTokenizer:
    """The file's normalisation, pre-splitting and merges, with a bounded memory of words seen."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.automaton = MergeAutomaton(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]])
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.around = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        self.split = regex.compile(PRE_SPLIT)
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        labels = dict(enumerate(self.automaton.labels)) | {i: t for t, i in self.specials.items()}
        self.labels = np.array([labels.get(i, "") for i in range(max(labels, default=-1) + 1)], dtype=object)

    def _remember(self, word: str, packed: bytes) -> bytes:
        if len(self.words) >= WORDS_MOST:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = packed
        return packed

    def _part(self, part: str) -> bytes:
        plain = part.isascii() and part.isprintable()
        letters = part if plain else "".join([self.letters[b] for b in part.encode()])
        return self._remember(part, np.array(self.automaton.encode(letters), dtype="<u4").tobytes())

    def _word(self, word: str) -> bytes:
        if word.isascii() and word.isalpha():
            return self._part(word)
        known = self.words.get
        parts = self.split.findall(word)
        packed = b"".join([known(p) or self._part(p) for p in parts])
        return packed if len(parts) == 1 else self._remember(word, packed)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Lower-casing goes letter by letter: a sigma at a word's end is no exception.
        text = text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))
        # str.split() also cuts at four control characters that are not white space here.
        words = regex.split(r"\s+", text) if regex.search("[\x1c-\x1f]", text) else text.split()
        known = self.words.get
        return b"".join([known(w) or self._word(w) for w in words])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.around is None or "<|" not in text:
            return self._plain(text)
        parts = self.around.split(text)
        return b"".join(np.uint32(self.specials[p]).astype("<u4").tobytes() if p in self.specials else self._plain(p) for p in parts)

    def decode(self, packed: bytes) -> str:
        """The labels of the arcs, one space between them: the file names no decoder."""
        return " ".join(self.labels[np.frombuffer(packed, dtype="<u4")])


@lru_cache(maxsize=2)
def tokenizer_of(spec: str) -> WordTokenizer:
    """One for all tasks of a worker, so that words seen stay known."""
    return WordTokenizer(spec)


def _specification(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens): every whole text encoded; ids are little-endian unsigned 32-bit integers.

    ``path`` names a tokenizer file on the driver; its text, of fixed size, is
    broadcast. A null text counts as empty and gives no ids. Rows stay as they are,
    repeated ones and null ids included; other columns are dropped.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_specification(path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(spec.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                ids = [tokenizer.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=["doc_id", "ids", "n_tokens"]
                )

    rows = texts(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(encode, f"doc_id {kind}, ids binary, n_tokens bigint")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the labels that the ids stand for; null ids give a null text."""
    spec = encoded.sparkSession.sparkContext.broadcast(_specification(path))
    at = encoded.columns.index("ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_of(spec.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                out = [None if (ids := x.as_py()) is None else tokenizer.decode(ids) for x in part.column(at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])

    schema = encoded.select("*", F.lit("").alias("decoded")).schema
    return encoded.mapInArrow(decode, schema)


def id_array(ids):
    """The packed ids as array<int>, in SQL functions."""
    hexed = F.hex(ids)
    at = lambda i: F.concat(*[F.substring(hexed, i * 8 + k, 2) for k in (7, 5, 3, 1)])
    n = F.length(ids) / 4
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.conv(at(i), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))
