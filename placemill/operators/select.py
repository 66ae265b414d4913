"""Which records a keyword asks for, and where."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill import dims
from placemill.functions.text import escape_keyword, normalise_keyword, to_title_case
from placemill.session import cut, written


def category_tokens(spark: SparkSession) -> DataFrame:
    """Fixed table of category rank and token."""
    rows = [(i, t) for i, c in enumerate(dims.CATEGORIES) for t in c.tokens]
    return spark.createDataFrame(rows, "rank int, token string")


def resolve_keyword(keywords: DataFrame) -> DataFrame:
    """Adds categories, generic, selectors, label and pattern.

    Each distinct keyword meets the fixed token table once; the two categories
    sharing the longest tokens win, equal ones in table order.
    """
    words = keywords.select("keyword").distinct().withColumn("k", normalise_keyword(F.col("keyword")))
    tokens = F.broadcast(category_tokens(keywords.sparkSession))
    shared = F.col("k").contains(F.col("token")) | F.col("token").contains(F.col("k"))
    hits = words.join(tokens, shared).groupBy("keyword", "rank").agg(F.max(F.length("token")).alias("score"))
    top = hits.groupBy("keyword").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "rank"))), 1, 2).alias("top"))
    fallback = dims.CATEGORIES[0]
    known = F.col("top").isNotNull()
    words = words.join(top, "keyword", "left").withColumn("safe", escape_keyword(F.col("k")))
    generic = ~known & (F.col("safe") != "")
    ids = F.array(*[F.lit(c.id) for c in dims.CATEGORIES])
    labels = F.array(*[F.lit(c.label) for c in dims.CATEGORIES])
    selectors = F.array(*[F.array(*[F.lit(s) for s in c.selectors]) for c in dims.CATEGORIES])
    pattern = F.replace("safe", F.lit(" "), F.lit(".*"))
    keys = F.array(*[F.lit(k) for k in [*dims.GENERIC_KEYS, "name"]])
    resolved = words.select(
        "keyword",
        F.when(known, F.transform("top", lambda h: ids[h["rank"]])).when(generic, F.expr("cast(array() as array<string>)"))
        .otherwise(F.array(F.lit(fallback.id))).alias("categories"),
        generic.alias("generic"),
        F.when(known, F.array_distinct(F.flatten(F.transform("top", lambda h: selectors[h["rank"]]))))
        .when(generic, F.transform(keys, lambda k: F.concat(k, F.lit("~(?i)"), pattern)))
        .otherwise(F.array(*[F.lit(s) for s in fallback.selectors])).alias("selectors"),
        F.when(known, labels[F.try_element_at("top", F.lit(1))["rank"]]).when(generic, to_title_case(F.col("k")))
        .otherwise(F.lit(fallback.label)).alias("label"),
        F.when(generic, pattern).alias("pattern"),
    )
    return keywords.join(resolved, "keyword")


def condition(selector: str, tags: Column) -> Column:
    """``k=v & k~re & k`` as one boolean over the tag map."""

    def one(part: str) -> Column:
        for sign in ("~", "="):
            if sign in part:
                key, _, value = part.partition(sign)
                return tags[key].rlike(value) if sign == "~" else tags[key] == value
        return tags[part].isNotNull()

    parts = [one(p.strip()) for p in selector.split(" & ")]
    return F.coalesce(reduce(lambda a, b: a & b, parts), F.lit(False))


def matches_any(selectors, tags: Column) -> Column:
    return reduce(lambda a, b: a | b, [condition(s, tags) for s in selectors])


def filter_by_selectors(df: DataFrame, category: str) -> DataFrame:
    return df.where(matches_any(dims.CATEGORY_BY_ID[category].selectors, F.col("tags")))


def matching_categories(tags: Column) -> Column:
    """Ids of every category whose selectors accept the tags."""
    ids = [F.when(matches_any(c.selectors, tags), F.lit(c.id)) for c in dims.CATEGORIES]
    return F.array_compact(F.array(*ids))


def generic_match(tags: Column, pattern: Column) -> Column:
    """Case-insensitive pattern on any of the generic keys or the name."""
    rx = F.concat(F.lit("(?i)"), pattern)
    hits = [F.coalesce(F.regexp(tags[k], rx), F.lit(False)) for k in [*dims.GENERIC_KEYS, "name"]]
    return reduce(lambda a, b: a | b, hits)


def filter_generic(df: DataFrame, keyword: str) -> DataFrame:
    """Rows matching a keyword of no category; an empty one means the general category."""
    safe = escape_keyword(normalise_keyword(F.lit(keyword)), ascii_only=keyword.isascii())
    broad = matches_any(dims.CATEGORIES[0].selectors, F.col("tags"))
    return df.where(F.when(safe == "", broad).otherwise(generic_match(F.col("tags"), F.replace(safe, F.lit(" "), F.lit(".*")))))


def select_candidates(records: DataFrame, searches: DataFrame) -> DataFrame:
    """Records of every search at once: its categories' selectors, or its pattern where it has none.

    ``records.tags`` should be a stored column: the tests look tags up many times. Adds categories and label.
    """
    wanted = searches.select("search_id", "categories", "label", "pattern")
    joined = records.join(wanted, "search_id")
    return joined.where(
        F.when(F.col("pattern").isNotNull(), generic_match(F.col("tags"), F.col("pattern")))
        .otherwise(F.arrays_overlap(matching_categories(F.col("tags")), "categories"))
    ).drop("pattern")


def within_box(df: DataFrame, south: float, west: float, north: float, east: float) -> DataFrame:
    """Plain ranges on two columns, so they reach the file scan."""
    return df.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))


def within_area(records: DataFrame, areas: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Rows of each search inside its area: by membership where it has an area id, else by box."""
    box = areas.select("search_id", "area_id", "south", "west", "north", "east")
    rows = records.join(box, "search_id")
    boxed = rows.where(
        F.col("area_id").isNull() & F.col("lat").between(F.col("south"), F.col("north"))
        & F.col("lon").between(F.col("west"), F.col("east"))
    )
    if members is not None:
        inside = rows.where(F.col("area_id").isNotNull()).join(members.select("area_id", "id").distinct(), ["area_id", "id"], "left_semi")
        boxed = boxed.unionByName(inside)
    return boxed.drop("area_id", "south", "west", "north", "east")


def category_classes(spark: SparkSession) -> DataFrame:
    """Fixed table of category ids and knowledge-base classes."""
    rows = [(c, q) for c, classes in dims.CLASSES.items() for q in classes]
    return spark.createDataFrame(rows, "category string, class_id string")


def classes_for(categories: DataFrame) -> DataFrame:
    """First category to its classes; a category without classes gives no rows."""
    return categories.join(F.broadcast(category_classes(categories.sparkSession)), "category")


def subclass_closure(edges: DataFrame) -> DataFrame:
    """(child, ancestor, depth) over any number of steps, shortest depth kept; cycles end by themselves.

    Both sides of a step grow with the edges, so neither is broadcast: every step would send its share through the driver.
    """
    edges = written(edges.select("child", "parent").where(F.col("child").isNotNull() & F.col("parent").isNotNull()).distinct(), "edges")
    frontier = cut(edges.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")))
    closure = frontier
    step = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("up")).hint("merge")
    depth = 1
    while True:
        depth += 1
        grown = frontier.join(step, "ancestor").select("child", F.col("up").alias("ancestor")).distinct()
        frontier = cut(grown.join(closure.hint("merge"), ["child", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return closure
        closure = cut(closure.unionByName(frontier)) if depth % 16 == 0 else closure.unionByName(frontier)


def classes_below(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, class_id): the classes of ``roots`` (class_id) and all below them, step by step down from the roots.

    A step joins only the classes found last with the edges, so the work follows the
    wanted part of the hierarchy; cycles end by themselves. Null ids are left out.
    """
    down = edges.select(F.col("parent").alias("class_id"), "child").where(F.col("child").isNotNull() & F.col("class_id").isNotNull())
    named = roots.select("class_id").where(F.col("class_id").isNotNull()).distinct()
    found = frontier = cut(named.select(F.col("class_id").alias("root"), "class_id"))
    depth = 0
    while True:
        depth += 1
        grown = frontier.join(down, "class_id").select("root", F.col("child").alias("class_id")).distinct()
        frontier = cut(grown.join(found, ["root", "class_id"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = cut(found.unionByName(frontier)) if depth % 16 == 0 else found.unionByName(frontier)


def instances_of(members: DataFrame, edges: DataFrame, classes: DataFrame) -> DataFrame:
    """(entity_id, category): entities whose type is a class of the category or lies below one."""
    below = classes_below(edges, classes).withColumnRenamed("class_id", "type_id")
    wanted = below.join(classes.withColumnRenamed("class_id", "root"), "root").select("type_id", "category").distinct()
    return members.join(wanted, "type_id").select("entity_id", "category").distinct()


def best_geocode(found: DataFrame) -> DataFrame:
    """One area per query: structured attempts first, then boundaries and towns over stray points."""
    from placemill.operators.rank import first_per

    plus = lambda cond, n: F.when(cond, n).otherwise(0)
    score = (
        plus(F.col("osm_type") == "relation", 10) + plus(F.col("class").isin("boundary", "place"), 5)
        + plus(F.col("type").isin("city", "town", "administrative", "municipality"), 5)
    )
    return first_per(found.withColumn("rank", score), ["query_id"], [F.col("attempt"), F.col("rank").desc(), F.col("ord")])
