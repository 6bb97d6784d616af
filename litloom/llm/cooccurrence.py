"""Items that appear together: pair counts by heavy-light decomposition, and lift.

Items below the least pair support can be in no reported pair and items in
more than 1 / least_lift of all rows neither (n_ab <= n_a gives lift <= n /
n_b); both are left out before any pair is formed, without loss.  Of the rest,
heavy items (in at least 1 / heavy_share of all rows; their number is bounded
by heavy_share x the mean basket size) are counted pair by pair as popcounts of
a dense bit matrix over blocks of rows; pairs of light items are counted by
hash; mixed pairs by probing the light items' row lists against the bit
matrix.  Blocks send partial sums only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.runtime import cut

BLOCK = 1 << 15  # rows of a block of the bit matrix
PAIRS = 1 << 21  # light pairs held before they are summed


def _hash_sum(a: np.ndarray, b: np.ndarray, w: np.ndarray | None = None):
    """Sums per distinct pair."""
    n = int(b.max()) + 1 if len(b) else 1
    code = a.astype(np.int64) * n + b
    if w is None:
        u, c = np.unique(code, return_counts=True)
    else:
        u, inv = np.unique(code, return_inverse=True)
        c = np.bincount(inv, weights=w).astype(np.int64)
    return u // n, u % n, c


def _light_pairs(row: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of light items of the same row, in slices; row is sorted, items ascend within a row."""
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.array([], int)
    size = np.diff(np.r_[start, len(row)])
    end = np.repeat(start + size, size)
    at = np.arange(len(row))
    step = 1
    while True:
        at = at[at + step < end[at]]
        if not len(at):
            return
        yield item[at], item[at + step]
        step += 1


def _block(rows: np.ndarray, items: np.ndarray, heavy: np.ndarray, n_rows: int):
    """Partial (a, b, n) of one block; rows and items are parallel, each row's items distinct."""
    order = np.lexsort((items, rows))
    rows, items = rows[order], items[order]
    place = np.searchsorted(heavy, items)
    is_heavy = (place < len(heavy)) & (heavy[np.minimum(place, max(len(heavy) - 1, 0))] == items) if len(heavy) else np.zeros(len(items), bool)
    # heavy x heavy: popcounts of packed rows
    bits = None
    if is_heavy.any():
        used, local = np.unique(place[is_heavy], return_inverse=True)
        words = (n_rows + 63) // 64
        bits = np.zeros((len(used), words), np.uint64)
        r = rows[is_heavy]
        np.bitwise_or.at(bits, (local, r >> 6), np.uint64(1) << (r & 63).astype(np.uint64))
        for i in range(len(used) - 1):
            n = np.bitwise_count(bits[i] & bits[i + 1 :]).sum(axis=1, dtype=np.int64)
            hit = np.flatnonzero(n)
            if len(hit):
                yield np.full(len(hit), heavy[used[i]]), heavy[used[i + 1 + hit]], n[hit]
    light_rows, light_items = rows[~is_heavy], items[~is_heavy]
    if not len(light_items):
        return
    names, local_item = np.unique(light_items, return_inverse=True)
    # light x heavy: probe each light item's list of rows against the bit matrix
    if bits is not None:
        by = np.argsort(local_item, kind="stable")
        list_rows, list_items = light_rows[by], local_item[by]
        first = np.flatnonzero(np.r_[True, list_items[1:] != list_items[:-1]])
        word, shift = list_rows >> 6, (list_rows & 63).astype(np.uint64)
        for i in range(len(bits)):
            hit = ((bits[i, word] >> shift) & np.uint64(1)).astype(np.int64)
            n = np.add.reduceat(hit, first)
            got = np.flatnonzero(n)
            if len(got):
                h = np.full(len(got), heavy[used[i]])
                x = names[list_items[first[got]]]
                yield np.minimum(h, x), np.maximum(h, x), n[got]
    # light x light: hash counts
    held_a, held_b, held = [], [], 0
    for a, b in _light_pairs(light_rows, local_item):
        held_a.append(a)
        held_b.append(b)
        held += len(a)
        if held > PAIRS:
            x, y, n = _hash_sum(np.concatenate(held_a), np.concatenate(held_b))
            yield names[x], names[y], n
            held_a, held_b, held = [], [], 0
    if held:
        x, y, n = _hash_sum(np.concatenate(held_a), np.concatenate(held_b))
        yield names[x], names[y], n


def _count_blocks(heavy_ids: list[int]):
    heavy = np.sort(np.array(heavy_ids, np.int64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[np.ndarray] = []
        items: list[np.ndarray] = []
        n = 0

        def flush():
            if n:
                for a, b, c in _block(np.concatenate(rows), np.concatenate(items), heavy, n):
                    yield pd.DataFrame({"a": a, "b": b, "n": c})

        for pdf in batches:
            lists = pdf["ids"].tolist()
            for s in range(0, len(lists), 4096):
                part = lists[s : s + 4096]
                size = np.fromiter(map(len, part), np.int64, len(part))
                if size.sum():
                    items.append(np.concatenate(part).astype(np.int64))
                    rows.append(np.repeat(np.arange(n, n + len(part)), size))
                n += len(part)
                if n >= BLOCK:
                    yield from flush()
                    rows, items, n = [], [], 0
        yield from flush()

    return run


def item_pairs(
    baskets: DataFrame,
    key: str = "record_id",
    items: str = "items",
    n_rows: int | None = None,
    least_together: int = 6,
    least_lift: float = 5.0,
    heavy_share: int = 256,
) -> DataFrame:
    """``item_a, item_b, n_a, n_b, n_ab, lift`` of every pair with the least count and lift.

    ``baskets`` has a unique key and an array of items per row; an item counts
    once per row.  Null or empty arrays form no pair; null items do not count;
    equal rows count separately; an empty table gives no row.  ``n_rows`` is
    the number of all rows (default: those of ``baskets``).  item_a < item_b.
    A basket of any size is counted whole, in slices.
    """
    spark = baskets.sparkSession
    schema = "item_a string, item_b string, n_a long, n_b long, n_ab long, lift double"
    n = baskets.count() if n_rows is None else n_rows
    if not n:
        return spark.createDataFrame([], schema)
    one = baskets.select(F.col(key).alias("k"), F.explode(F.array_distinct(items)).alias("item")).filter("item is not null")
    counts = one.groupBy("item").agg(F.count("*").alias("n")).filter((F.col("n") >= least_together) & (F.col("n") * least_lift <= n))
    # Ids are fixed by the checkpoint: what is recomputed after a loss reads the same ids.
    dictionary = cut(counts.withColumn("id", F.monotonically_increasing_id()))
    # Bounded by heavy_share x mean basket size, whatever the number of rows.
    is_heavy = F.col("n") * heavy_share >= n
    top = dictionary.filter(is_heavy).select("item", "id")
    heavy = [r["id"] for r in top.select("id").collect()]
    # Heavy items are looked up in every task; only rows of light items move, and a light item has few.
    light = one.join(F.broadcast(top), "item", "left_anti").join(dictionary.filter(~is_heavy).select("item", "id"), "item")
    known = one.join(F.broadcast(top), "item").select("k", "id").unionByName(light.select("k", "id"))
    lists = known.groupBy("k").agg(F.collect_list("id").alias("ids")).filter(F.size("ids") >= 2).select("ids")
    pairs = (
        lists.mapInPandas(_count_blocks(heavy), "a long, b long, n long")
        .groupBy("a", "b")
        .agg(F.sum("n").alias("n_ab"))
        .filter(F.col("n_ab") >= least_together)
    )
    left = dictionary.select(F.col("id").alias("a"), F.col("item").alias("item_1"), F.col("n").alias("n_1"))
    right = dictionary.select(F.col("id").alias("b"), F.col("item").alias("item_2"), F.col("n").alias("n_2"))
    both = pairs.join(left, "a").join(right, "b").filter(F.col("n_ab") * n >= F.lit(least_lift) * F.col("n_1") * F.col("n_2"))
    first = F.col("item_1") < F.col("item_2")
    return both.select(
        F.least("item_1", "item_2").alias("item_a"),
        F.greatest("item_1", "item_2").alias("item_b"),
        F.when(first, F.col("n_1")).otherwise(F.col("n_2")).alias("n_a"),
        F.when(first, F.col("n_2")).otherwise(F.col("n_1")).alias("n_b"),
        "n_ab",
        (F.col("n_ab") * F.lit(float(n)) / (F.col("n_1") * F.col("n_2"))).alias("lift"),
    )
