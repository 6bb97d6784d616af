"""Pairs of items that share a container: coupling, co-citation, co-occurrence, collaboration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.runtime import cut, stored

TILE = 2048  # items of a container whose pairs one task forms at once


def pair_counts(rows: DataFrame, container: str, item: str, least: int = 1, tile: int = TILE) -> DataFrame:
    """[J7-J11, U4, F12] ``src, dst, weight``: containers that two items share, src < dst.

    Items count once per container.  Pairs are formed from sorted arrays (no
    self-join), and only of items in ``least`` containers or more: others can't
    reach the weight.  Nulls form no pair.  A container of more than ``tile``
    items is split by hash into tiles, and every two of its tiles are one
    array of their own, so that no task forms all its pairs; the result is the
    same.
    """
    d = rows.select(F.col(container).alias("c"), F.col(item).alias("i")).filter("c is not null and i is not null").distinct()
    if least > 1:
        d = d.join(d.groupBy("i").count().filter(F.col("count") >= least).select("i"), "i")
    hot = d.groupBy("c").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("c", F.ceil(F.col("n") / tile).alias("tiles"))
    # As a rule there is no such container, and adaptive execution drops both joins.
    few = d.join(hot, "c", "left_anti").groupBy("c").agg(F.array_sort(F.collect_list("i")).alias("a")).filter(F.size("a") > 1)
    many = d.join(hot, "c").withColumn("t", F.pmod(F.xxhash64("i"), F.col("tiles")))
    many = many.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    many = many.select("c", "i", "t", F.least("t", "o").alias("x"), F.greatest("t", "o").alias("y")).repartition("c", "x", "y")  # else a container's tiles stay together
    one = F.col("x") == F.col("y")
    mine, other = F.when(F.col("t") == F.col("x"), F.col("i")), F.when(~one & (F.col("t") == F.col("y")), F.col("i"))
    tiles = many.groupBy("c", "x", "y").agg(F.array_sort(F.collect_list(mine)).alias("a"), F.collect_list(other).alias("b"))
    lists = few.select(F.lit(True).alias("one"), "a", F.slice("a", 1, 0).alias("b")).unionByName(tiles.select(one.alias("one"), "a", "b"))
    first = lists.select("one", "a", "b", F.posexplode("a").alias("p", "u"))
    # Within a tile each item meets those after it, across two tiles all of the other.
    two = first.select("u", F.explode(F.when(F.col("one"), F.slice("a", F.col("p") + 2, F.size("a"))).otherwise(F.col("b"))).alias("v"))
    return two.groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


SIDE = 256  # items that meet at once in ``coupled``: generated code keeps the pairs of a tile until all are formed
MOST = 64  # containers of an item whose pairs are formed at once


def coupled(rows: DataFrame, container: str, item: str, tile: int = SIDE, most: int = MOST) -> DataFrame:
    """[J7, U4, F12] ``pair_counts`` at a weight of two or more, for items of few containers each (papers and the works they cite).

    Nothing is formed or moved for two items that share one container only:
    items meet in every *pair* of containers they have in common, and come
    out where these are the first two they share, with their weight.  Pairs
    of items are not moved at all.  Masks of the other containers tell what
    most pairs share besides; for the rest the lists are compared.  Pairs
    of containers with more than ``tile`` items are split into tiles as in
    ``pair_counts``; items of more than ``most`` containers meet the others
    by counting.
    """
    d = stored(rows.select(F.col(container).alias("c"), F.col(item).alias("i")).filter("c is not null and i is not null"))
    # Numbered by frequency, so that those most often shared have bits of their own.
    number = d.groupBy("c").agg(F.count("*").alias("n")).filter("n > 1").orderBy(F.desc("n"), "c").select("c", F.monotonically_increasing_id().alias("w"))
    lists = cut(d.join(cut(number), "c").groupBy("i").agg(F.sort_array(F.collect_set("w")).alias("ws")).filter(F.size("ws") > 1))
    met = lists.filter(F.size("ws") <= most).select("i", "ws", F.posexplode("ws").alias("p", "w1")).select("i", "ws", "w1", F.explode(F.slice("ws", F.col("p") + 2, F.size("ws"))).alias("w2"))
    rest = F.filter("ws", lambda w: (w != F.col("w1")) & (w != F.col("w2")))
    none = F.lit(0).cast("long")
    at_bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))
    # The 64 works cited most have exact bits (m0), all others share those of m1 and m2.
    part = lambda w: F.when(w < 64, 0).when(w.bitwiseAND(F.lit(64)) == 0, 1).otherwise(2)
    bits = lambda m: F.aggregate("o", none, lambda a, w: a.bitwiseOR(F.when(part(w) == m, at_bit(w)).otherwise(none)))
    met = met.withColumn("o", rest)
    hot = cut(met.groupBy("w1", "w2").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select("w1", "w2", F.ceil(F.col("n") / tile).alias("tiles")))  # of all rows one in ``tile`` at most
    met = met.select("w1", "w2", F.struct("i", *[bits(m).alias(f"m{m}") for m in (0, 1, 2)], "o").alias("x"))
    few = met.join(F.broadcast(hot), ["w1", "w2"], "left_anti").groupBy("w1", "w2").agg(F.sort_array(F.collect_list("x")).alias("a")).filter(F.size("a") > 1)
    many = met.join(F.broadcast(hot), ["w1", "w2"]).withColumn("t", F.pmod(F.xxhash64("x.i"), F.col("tiles")))
    many = many.withColumn("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    many = many.select("w1", "w2", "x", "t", F.least("t", "u").alias("y"), F.greatest("t", "u").alias("z"))
    parts = 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows, much work: by number, not by size
    mine, other = F.when(F.col("t") == F.col("y"), F.col("x")), F.when((F.col("y") != F.col("z")) & (F.col("t") == F.col("z")), F.col("x"))
    tiles = many.repartition(parts, "w1", "w2", "y", "z").groupBy("w1", "w2", "y", "z").agg(F.sort_array(F.collect_list(mine)).alias("a"), F.sort_array(F.collect_list(other)).alias("b"))
    same = F.col("y") == F.col("z")
    tiles = tiles.select("w1", "w2", same.alias("one"), "a", F.when(same, F.col("a")).otherwise(F.col("b")).alias("b"))
    both = few.select("w1", "w2", F.lit(True).alias("one"), "a", F.col("a").alias("b")).unionByName(tiles)
    flat = both.select("w2", "one", *[F.col(f"{s}.{f}").alias(f"{s}_{f}") for s in "ab" for f in ("i", "m0", "m1", "m2", "o")])
    first = flat.select("*", F.posexplode("a_i").alias("p", "u"))
    start = F.when(F.col("one"), F.col("p") + 1).otherwise(0)
    at = F.when(start < F.size("b_i"), F.sequence(start, F.size("b_i") - 1))
    two = first.select(*first.columns, F.explode(at).alias("q"))
    left, right = (lambda f: F.get(f"a_{f}", F.col("p"))), (lambda f: F.get(f"b_{f}", F.col("q")))
    known = left("m0").bitwiseAND(right("m0"))
    apart = left("m1").bitwiseAND(right("m1")).bitwiseOR(left("m2").bitwiseAND(right("m2"))) == 0
    every = F.lit(-1).cast("long")
    low = F.when(F.col("w2") < 64, F.bitwise_not(F.call_function("shiftleft", every, F.col("w2").cast("int")))).otherwise(every)
    more = F.when(apart, F.array().cast("array<bigint>")).otherwise(F.array_intersect(left("o"), right("o")))
    near = two.filter(known.bitwiseAND(low) == 0)  # else they meet in an earlier pair of works
    ends = near.select("w2", "u", right("i").alias("v"), F.when(apart, F.bit_count(known)).alias("n"), F.explode(F.array(more)).alias("more"))  # exploded, so that it is found once
    ends = ends.filter(F.coalesce(F.array_min("more") > F.col("w2"), F.lit(True)))
    got = ends.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst"), (F.coalesce("n", F.size("more")) + 2).cast("long").alias("weight"))
    one = lists.select("i", (F.size("ws") > most).alias("long"), F.explode("ws").alias("w"))
    wide = one.filter("long").select("w", F.col("i").alias("u")).join(one.select("w", F.col("i").alias("v"), "long"), "w").filter("u < v or (u > v and not long)")
    wide = wide.groupBy(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.count("*").alias("weight")).filter("weight > 1")
    return got.unionByName(wide)


def supported(rows: DataFrame, item: str, least: int = 2, container: str | None = None) -> DataFrame:
    """Rows of items that occur ``least`` times or more (in distinct containers if one is named)."""
    n = F.count_distinct(container) if container else F.count("*")
    keep = rows.groupBy(item).agg(n.alias("_n")).filter(F.col("_n") >= least).select(item)
    return rows.join(keep, item, "left_semi")


def among_top(rows: DataFrame, container: str, item: str, k: int, least: int = 1) -> DataFrame:
    """[A11, T1, J8, G2] Pair counts among the k items that occur most (occurrences; ties by item)."""
    best = rows.filter(F.col(item).isNotNull()).groupBy(item).agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), item).limit(k).select(item)
    return pair_counts(rows.join(F.broadcast(best), item, "left_semi"), container, item, least)


def ordered_pairs(rows: DataFrame, ids: str) -> DataFrame:
    """[J11] ``a, b`` for every two positions of an array, repeats and equal ids kept."""
    d = rows.select(F.col(ids).alias("x"), F.posexplode(ids).alias("p", "a"))
    return d.select("a", F.explode(F.slice("x", F.col("p") + 2, F.size("x"))).alias("b"))


def zipped(ids: Column, names: Column) -> Column:
    """[J12] ``id, name`` by position; the id itself where there is no name."""
    at = F.sequence(F.lit(0), F.size(ids) - 1)
    pairs = F.transform(at, lambda i: F.struct(F.get(ids, i).alias("id"), F.coalesce(F.get(names, i), F.get(ids, i)).alias("name")))
    return F.when(F.size(ids) > 0, pairs).otherwise(F.array().cast("array<struct<id:string,name:string>>"))


def first_names(rows: DataFrame, ids: str, names: str, order: str) -> DataFrame:
    """[J12] ``id, name``: the first name seen of every id."""
    d = rows.select(F.col(order).alias("o"), F.posexplode(zipped(F.col(ids), F.col(names))).alias("p", "x"))
    return d.groupBy("x.id").agg(F.min_by("x.name", F.struct("o", "p")).alias("name"))


def per_row_product(rows: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """[J13] ``key, a, b``: every element of one array with every element of the other, within the row."""
    return rows.select(key, F.explode(a).alias("a"), F.col(b).alias("_b")).select(key, "a", F.explode("_b").alias("b"))


def mentions(rows: DataFrame, item: str, terms: tuple[str, ...]) -> DataFrame:
    """[J14] ``rows`` with ``term`` for every term that an item contains; terms are a short fixed list."""
    low = F.lower(F.col(item))
    found = F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in terms]), lambda t: t.isNotNull())
    return rows.withColumn("term", F.explode(found))
