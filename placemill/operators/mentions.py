"""Which texts hold which names: an inverted join on each name's rarest word.

A text that holds a name holds the words of the name: an inner word stands there as a
whole, the first word ends a word of the text, the last one begins one, and a single
word may lie inside one. So names are matched against the vocabulary of the texts
first, which is small beside them; the number of texts in which a name's word can
occur is a sum over the vocabulary. Each name is looked for by the word with the
smallest such number, and the whole name is compared where that word stands. A
name with a word that no text has is looked for nowhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placemill.session import written

# First and last words meet the vocabulary on so many letters, single words on runs of GRAM; the rest is compared.
EDGE = 6
GRAM = 3
BREAK = r"\s+"


def words_of_texts(texts: DataFrame) -> DataFrame:
    """(row, word): the distinct words of each text, as white space sets them off."""
    return texts.select("row", F.explode(F.array_distinct(F.split("low", BREAK))).alias("word")).where(F.col("word") != "")


def words_of_names(needles: DataFrame) -> DataFrame:
    """(needle, pos, kind, token): how each word of a name stands in a text that holds it."""
    parts = needles.select("needle", F.split("needle", BREAK).alias("parts"))
    at = parts.select("needle", F.size("parts").alias("n"), F.posexplode("parts").alias("pos", "token")).where(F.col("token") != "")
    kind = F.when(F.col("n") == 1, "inside").when(F.col("pos") == 0, "ends").when(F.col("pos") == F.col("n") - 1, "begins").otherwise("whole")
    return at.select("needle", "pos", kind.alias("kind"), "token")


def _cuts(df: DataFrame, longest: Column, cut: Callable[[Column], Column], name: str) -> DataFrame:
    """A row for each number from 1 to ``longest``, with ``cut`` of it as ``name``."""
    return df.withColumn("_n", F.explode(F.sequence(F.lit(1), longest))).withColumn(name, cut(F.col("_n"))).drop("_n")


def _runs(df: DataFrame, word: str) -> DataFrame:
    """The runs of GRAM letters of each ``word``; one that it holds twice comes twice."""
    return _cuts(df.where(F.length(word) >= GRAM), F.length(word) - GRAM + 1, lambda n: F.substr(F.col(word), n, F.lit(GRAM)), "run")


def matching_words(vocabulary: DataFrame, wanted: DataFrame, edge: int = EDGE) -> DataFrame:
    """(kind, token, word, texts): the words of the vocabulary (word, texts) that each wanted (kind, token) may stand in."""

    def of(kind: str) -> DataFrame:
        return wanted.where(F.col("kind") == kind).drop("kind")

    whole = of("whole").join(vocabulary, F.col("token") == F.col("word")).select(F.lit("whole").alias("kind"), "token", "word", "texts")
    lengths = F.least(F.length("word"), F.lit(edge))
    first = lambda c, n: F.substr(c, F.lit(1), n)
    last = lambda c, n: F.right(c, n)
    short = F.least(F.length("token"), F.lit(edge))
    by_edge = []
    for kind, cut, holds in (("begins", first, F.startswith), ("ends", last, F.endswith)):
        edges = _cuts(vocabulary, lengths, lambda n: cut(F.col("word"), n), "edge")  # noqa: B023
        asked = of(kind).withColumn("edge", cut(F.col("token"), short))
        by_edge.append(asked.join(edges, "edge").where(holds(F.col("word"), F.col("token"))).select(F.lit(kind).alias("kind"), "token", "word", "texts"))
    # A single word meets the vocabulary on the run that the fewest words have; only runs that are asked for are looked at.
    asked = written(_runs(of("inside"), "token").distinct(), "runs")
    runs = _runs(vocabulary, "word").join(asked.select("run").distinct(), "run", "left_semi")
    common = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(common, "run", "left").groupBy("token").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "run")).alias("best"))
    inside = rarest.select("token", "best.run").join(runs, "run").where(F.contains(F.col("word"), F.col("token"))).select(F.lit("inside").alias("kind"), "token", "word", "texts").distinct()
    return whole.unionByName(by_edge[0]).unionByName(by_edge[1]).unionByName(inside)


def rarest_words(names: DataFrame, matched: DataFrame) -> DataFrame:
    """(needle, kind, token): of each name's words the one that the fewest texts can hold; names of which some word is in no text are left out."""
    costs = matched.groupBy("kind", "token").agg(F.sum("texts").alias("cost"))
    best = F.min(F.struct(F.coalesce("cost", F.lit(0)).alias("cost"), "pos", "kind", "token")).alias("best")
    return names.join(costs, ["kind", "token"], "left").groupBy("needle").agg(best).where("best.cost > 0").select("needle", "best.kind", "best.token")


def mentions(docs: DataFrame, needles: DataFrame, edge: int = EDGE) -> DataFrame:
    """The columns of ``docs`` and ``needle`` for every document whose ``text``, in lower case, contains the needle.

    ``needles``: distinct lower-case strings of GRAM letters or more, without white
    space at either end. A null text holds nothing. ``docs`` must read the same each
    time. Texts are cut into words once; the words are written and serve both for the
    counts and for the join. A word that many texts hold is a hot key of a plain
    equality join, and only where some name has no rarer one.
    """
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    texts = rows.select(F.col("_row").alias("row"), F.lower("text").alias("low"))
    words = written(words_of_texts(texts), "words")
    vocabulary = written(words.groupBy("word").agg(F.count(F.lit(1)).alias("texts")), "vocabulary")
    names = written(words_of_names(needles), "names")
    wanted = written(names.select("kind", "token").distinct(), "wanted")
    matched = written(matching_words(vocabulary, wanted, edge), "matched")
    # Written tables have a size that Spark knows, so small ones are broadcast and the words of the texts stay where they are.
    anchors = written(rarest_words(names, matched), "anchors")
    used = written(matched.join(anchors.select("kind", "token").distinct(), ["kind", "token"], "left_semi").select("kind", "token", "word"), "used")
    hits = words.join(used, "word").select("row", "kind", "token").distinct()
    # Written, so that the words' shuffle is gone when the texts move.
    candidates = written(hits.join(anchors, ["kind", "token"]).select(F.col("row").alias("_at"), "needle"), "candidates")
    return rows.join(candidates, (F.col("_row") == F.col("_at")) & F.contains(F.lower("text"), F.col("needle"))).drop("_row", "_at")
