"""Splits that keep related records together.

Components of the graph of shared keys come from random-mate contraction: each round every vertex throws a coin, one with
tails that has a neighbour with heads collapses into it, and the edges are rewritten by joins, until none is left. The
collapses of the rounds, read backwards, give every vertex the label of its component. Components are then dealt to the
splits by cumulative weight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexigrid.functions.script import roman_column
from lexigrid.session import cut

#: Cells that the components of one size class are put in before their weights are added up.
CELLS = 4096
#: A vertex that isn't reached by then is a sign of an error; each round removes a quarter of the vertices on average.
MOST_ROUNDS = 500
#: Rounds that are unwound in one plan.
UNWOUND = 3


def _heads(vertex: str, turn: int) -> Column:
    return F.xxhash64(F.col(vertex), F.lit(turn * 7919 + 17)) % 2 == 0


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex of edges (a, b), string or bigint; label is the same exactly in one component.

    Direction, repeated edges, loops and edges with a null end (left out) don't matter. An empty table gives an empty one.
    No vertex has its neighbours gathered: each round joins edges with the minimum of each tail's heads.
    """
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    vertices = cut(edges.select(F.col("a").alias("v")).unionByName(edges.select(F.col("b").alias("v"))).distinct())
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        if len(rounds) >= MOST_ROUNDS:
            raise RuntimeError("the contraction doesn't end")
        mates = _mates(edges, len(rounds))
        rounds.append(mates)
        to = lambda end: mates.select(F.col("a").alias(end), F.col("into").alias(f"{end}_into"))  # noqa: B023,E731
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_into", "a").alias("a"), F.coalesce("b_into", "b").alias("b"))
        edges = cut(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    # Unwinding: the mate of a vertex collapsed later or not at all, so that its label is known by then.
    known = None
    for turn, mates in enumerate(reversed(rounds)):
        if known is None:
            known = mates.select(F.col("a").alias("v"), F.col("into").alias("label"))
        else:
            later = known.select(F.col("v").alias("into"), "label")
            known = known.unionByName(mates.join(later, "into", "left").select(F.col("a").alias("v"), F.coalesce("label", "into").alias("label")))
        if turn % UNWOUND == UNWOUND - 1:
            known = cut(known)
    if known is None:
        return vertices.select("v", F.col("v").alias("label"))
    return vertices.join(known, "v", "left").select("v", F.coalesce("label", "v").alias("label"))


def _mates(edges: DataFrame, turn: int) -> DataFrame:
    """(a, into) of each vertex with tails that has a neighbour with heads. As edges is a written table and the coins follow
    from the vertices' names, a later read gives the same rows.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where(~_heads("a", turn) & _heads("b", turn)).groupBy("a").agg(F.min("b").alias("into"))


def record_groups(keys: DataFrame) -> DataFrame:
    """(id, group_id, size) of every id in keys (id bigint, key string): records that share a key, also over other records,
    are one group; group_id is its smallest id and size the number of its records.

    Null keys relate nothing; a record whose keys are all null is a group of its own. Repeated rows don't matter.
    A key that many records share is one vertex, and a record links its keys only with its smallest one.
    """
    keys = cut(keys.select("id", "key").where("id IS NOT NULL").distinct())
    first = keys.groupBy("id").agg(F.min("key").alias("a"))
    links = keys.join(first, "id").select("a", F.col("key").alias("b")).distinct()
    labelled = components(links)
    of = cut(first.join(labelled.withColumnRenamed("v", "a"), "a", "left").select("id", F.coalesce("label", F.concat(F.lit("\0alone "), F.col("id").cast("string"))).alias("label")))
    groups = of.groupBy("label").agg(F.min("id").alias("group_id"), F.count("*").alias("size"))
    return of.join(groups, "label").select("id", "group_id", "size")


def case_keys(cases: DataFrame) -> DataFrame:
    """(id, key) of analyzer cases: the word in Roman spelling and lower case without blanks around it, and the root of each
    analysis in the list of the correct ones. A case without either has one row with a null key.
    """
    blank = r"^[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{feff}]+|[\s\x{a0}\x{2000}-\x{200b}\x{202f}\x{feff}]+$"
    word = F.nullif(F.lower(roman_column(F.regexp_replace("word", blank, ""))), F.lit(""))
    root = F.transform(F.split(F.coalesce("all_correct_decomps", F.lit("")), ";"), lambda x: F.nullif(F.trim(F.regexp_extract(x, r"^\s*\{[^:{}]*:([^{}]*)\}", 1)), F.lit("")))
    keys = F.filter(F.concat(F.array(F.concat(F.lit("w "), word)), F.transform(root, lambda x: F.concat(F.lit("r "), x))), lambda x: x.isNotNull())
    return cases.select(F.col("case_id").alias("id"), F.explode_outer(F.array_distinct(keys)).alias("key"))


def assign_splits(groups: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(id, split_name) of every row of groups (id, group_id, size): a group is never divided, and the splits' shares of
    records come as close to targets (split_name, share) as the groups allow.

    Shares are taken relative to their sum; rows of targets with a null or non-positive share get nothing. Without any
    usable target the result is empty. Components are dealt by cumulative weight, by the power of two of their sizes: within each class, in
    an order drawn by seed, one goes to the split in whose part of the class's weight its middle falls. The parts are those of the records that the
    splits lack after the larger classes, so that what a large component takes too much is made up by smaller ones. There
    are at most 63 classes; only their sums by split come to the driver.
    """
    sizes = groups.select("group_id", "size").distinct().withColumn("class", F.floor(F.log2("size")).cast("int")).withColumn("draw", F.xxhash64("group_id", F.lit(seed)))
    sizes = cut(sizes.withColumn("cell", F.expr(f"pmod(shiftright(draw, 20), {CELLS})")))
    classes = {r["class"]: r["n"] for r in sizes.groupBy("class").agg(F.sum("size").alias("n")).collect()}
    total = sum(classes.values())
    wanted = [(r["split_name"], float(r["share"])) for r in targets.select("split_name", "share").where("share > 0 AND share < double('infinity') AND split_name IS NOT NULL").groupBy("split_name").agg(F.sum("share").alias("share")).orderBy(F.desc("share"), "split_name").collect()]
    if not wanted or not total:
        return groups.select("id", F.lit(None).cast("string").alias("split_name")).where("false")
    # Cumulative weight in two steps: over the cells of a class, whose number is fixed, and inside of each cell.
    cells = sizes.groupBy("class", "cell").agg(F.sum("size").alias("in_cell"))
    cells = cells.select("class", "cell", (F.sum("in_cell").over(Window.partitionBy("class").orderBy("cell")) - F.col("in_cell")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("class", "cell").orderBy("draw", "group_id")) - F.col("size")
    placed = sizes.withColumn("inside", inside).join(F.broadcast(cells), ["class", "cell"])
    placed = cut(placed.select("group_id", "size", "class", (F.col("before") + F.col("inside") + F.col("size") / 2).alias("middle")))
    whole = sum(x for _, x in wanted)
    lacking = {name: x / whole * total for name, x in wanted}
    split = F.lit(None).cast("string")
    for size_class in sorted(classes, reverse=True):
        parts = {name: max(x, 0.0) for name, x in lacking.items()}
        at, ends = 0.0, []
        for name, _ in wanted:
            at += parts[name] / (sum(parts.values()) or 1.0) * classes[size_class]
            ends.append((name, at))
        here = F.lit(next(name for name, _ in reversed(wanted) if parts[name] > 0 or not any(parts.values())))
        for name, end in reversed(ends[:-1]):
            here = F.when(F.col("middle") < end, F.lit(name)).otherwise(here)
        for r in placed.where(F.col("class") == size_class).groupBy(here.alias("name")).agg(F.sum("size").alias("n")).collect():
            lacking[r["name"]] -= r["n"]
        split = F.when(F.col("class") == size_class, here).otherwise(split)
    return groups.join(placed.select("group_id", split.alias("split_name")), "group_id").select("id", "split_name")


def split_shares(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split_name, target_share, records, share) for each target: the share of records that it really got."""
    total = assigned.agg(F.count("*").alias("total"))
    counts = assigned.groupBy("split_name").agg(F.count("*").alias("records"))
    out = targets.select("split_name", F.col("share").alias("target_share")).join(counts, "split_name", "left").crossJoin(F.broadcast(total))
    return out.select("split_name", "target_share", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("records", F.lit(0)) / F.nullif("total", F.lit(0))).alias("share"))
