"""Mixing sources to target weights by a low-discrepancy schedule.

Slot j of a mix belongs to the source in whose share of [0, 1) the point
frac(j x golden ratio) falls, so every stretch of the schedule holds the
sources in their target shares.  Each source's documents, in an order shuffled
anew for every repeat, are cut into blocks of equal tokens; the r-th slot of a
source takes its r-th block.  Ranks and running token sums are computed in two
levels (within hash buckets, then over bucket totals): no window spans a source.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.runtime import cut

GOLDEN = (math.sqrt(5) - 1) / 2
LEAST_BLOCK = 512  # tokens of a block at least: a few documents
CHUNK = 1 << 14  # slots of a chunk, and about the documents of a bucket


def plan_mixes(targets: list[tuple], totals: dict[str, int], total_tokens: int | None = None) -> list[dict]:
    """Per mix and source: share of the whole, tokens wanted, repeats needed.

    Shares are scaled to sum to 1 over the sources that exist.  A mix is as
    large as the scarcest source allows at its share and its repeats, unless
    ``total_tokens`` is given: then a source that can't reach its share gives
    all it can.  Null or non-positive shares and repeats give nothing.
    """
    out = []
    for mix in sorted({t[0] for t in targets}):
        rows: dict[str, list] = {}
        for m, s, share, rep in targets:
            if m == mix and s is not None and share and share > 0 and rep and rep > 0 and totals.get(s, 0) > 0:
                r = rows.setdefault(s, [0.0, 0])
                r[0] += share
                r[1] = max(r[1], int(rep))
        whole = sum(r[0] for r in rows.values())
        if not rows:
            continue
        size = min(totals[s] * r[1] * whole / r[0] for s, r in rows.items()) if total_tokens is None else total_tokens
        block = int(min(1 << 20, max(LEAST_BLOCK, size // 20_000)))
        at = 0.0
        for s in sorted(rows):
            share, rep = rows[s][0] / whole, rows[s][1]
            want = min(share * size, totals[s] * rep)
            out.append({"mix_id": mix, "source": s, "lo": at, "hi": at + share, "share": share, "want": want, "block": block, "slots": math.ceil(size / block), "epochs": min(rep, math.ceil(want / totals[s] + 1e-9))})
            at += share
        out[-1]["hi"] = 1.0
    return out


def mix_sources(
    sizes: DataFrame, targets: list[tuple], key: str = "doc_id", source: str = "source", n_tokens: str = "n_tokens", total_tokens: int | None = None, seed: int = 7
) -> DataFrame:
    """``mix_id, slot, source, key, use_no, n_tokens``: one row per use of a document.

    ``targets`` are (mix_id, source, target_share, max_repeats), a short list
    (one row per mix and source).  A document is used at most max_repeats
    times in a mix; whole repeats come before a part of a further one.
    Documents of no tokens, null sources and sources of no mix are not used;
    equal texts are documents of their own; an empty table gives no row.
    """
    spark = sizes.sparkSession
    kind = dict(sizes.dtypes)[key]
    schema = f"mix_id int, slot long, source string, {key} {kind}, use_no int, n_tokens long"
    d = sizes.select(F.col(key).alias("_k"), F.col(source).alias("_s"), F.col(n_tokens).cast("long").alias("_n")).filter("_n > 0 and _s is not null")
    wanted = sorted({t[1] for t in targets if t[1] is not None})
    d = d.filter(F.col("_s").isin(*wanted)) if wanted else d.limit(0)
    # One row per source of the targets.
    counted = {r["_s"]: (int(r["t"]), int(r["c"])) for r in d.groupBy("_s").agg(F.sum("_n").alias("t"), F.count("*").alias("c")).collect()}
    plan = plan_mixes(targets, {s: t for s, (t, _) in counted.items()}, total_tokens)
    if not plan:
        return spark.createDataFrame([], schema)
    rows = spark.createDataFrame(
        [(int(p["mix_id"]), p["source"], p["epochs"], float(p["want"]), p["block"], max(1, math.ceil(counted[p["source"]][1] / CHUNK))) for p in plan],
        "mix_id int, _s string, epochs int, want double, block long, buckets int",
    )
    uses = d.join(F.broadcast(rows), "_s").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    uses = uses.withColumn("h", F.xxhash64("_k", "epoch", F.lit(seed)))
    uses = uses.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.col("buckets")))
    by = ["mix_id", "_s", "epoch", "bucket"]
    sums = uses.groupBy(*by).agg(F.sum("_n").alias("t"))
    before = F.sum("t").over(Window.partitionBy("mix_id", "_s").orderBy("epoch", "bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(*by, F.coalesce(before, F.lit(0)).alias("before"))
    inner = F.sum("_n").over(Window.partitionBy(*by).orderBy("h", "_k").rowsBetween(Window.unboundedPreceding, -1))
    placed = uses.withColumn("inner", F.coalesce(inner, F.lit(0))).join(sums, by)
    placed = placed.withColumn("at", F.col("inner") + F.col("before")).filter(F.col("at") + F.col("_n") / 2 < F.col("want"))
    blocks = placed.select("mix_id", "_s", F.floor(F.col("at") / F.col("block")).cast("long").alias("rank"), "_k", "epoch", "_n", "want")
    # The schedule: points mapped through the cumulative weights, ranked per source.
    mixes: dict[int, list[dict]] = {}
    for p in plan:
        mixes.setdefault(int(p["mix_id"]), []).append(p)
    slots = None
    for mix, ps in sorted(mixes.items()):
        n = ps[0]["slots"]
        u = F.expr(f"(id * {GOLDEN!r}D) - floor(id * {GOLDEN!r}D)")
        src = F.lit(ps[-1]["source"])
        for p in reversed(ps[:-1]):
            src = F.when(F.col("u") < p["hi"], p["source"]).otherwise(src)
        part = spark.range(0, n, 1, max(1, n // (CHUNK * 16))).withColumn("u", u).select(F.lit(mix).cast("int").alias("mix_id"), F.col("id").alias("slot"), src.alias("_s"))
        slots = part if slots is None else slots.union(part)
    slots = slots.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    tally = slots.groupBy("mix_id", "_s", "chunk").agg(F.count("*").alias("c"))
    prior = F.sum("c").over(Window.partitionBy("mix_id", "_s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    tally = tally.select("mix_id", "_s", "chunk", F.coalesce(prior, F.lit(0)).alias("prior"))
    within = F.row_number().over(Window.partitionBy("mix_id", "_s", "chunk").orderBy("slot")) - 1
    ranked = slots.withColumn("within", within).join(tally, ["mix_id", "_s", "chunk"]).select("mix_id", "_s", (F.col("prior") + F.col("within")).alias("rank"), "slot")
    # The schedule has one slot more or less than a source's blocks; its last slot takes the blocks beyond.
    last = cut(ranked.groupBy("mix_id", "_s").agg(F.max(F.struct("rank", "slot")).alias("last")))
    got = blocks.join(F.broadcast(last), ["mix_id", "_s"]).withColumn("rank", F.least("rank", F.col("last.rank"))).join(ranked, ["mix_id", "_s", "rank"])
    return got.select("mix_id", "slot", F.col("_s").alias("source"), F.col("_k").alias(key), (F.col("epoch") + 1).cast("int").alias("use_no"), F.col("_n").alias("n_tokens"))


def mix_report(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per row of the targets: the share wanted and reached, tokens, documents and the most uses of one."""
    uses = mixed.groupBy("mix_id", "source", key).agg(F.sum("n_tokens").alias("t"), F.count("*").alias("uses"))
    per = uses.groupBy("mix_id", "source").agg(F.sum("t").alias("tokens"), F.count("*").alias("n_docs"), F.max("uses").alias("most_uses"))
    per = per.withColumn("reached_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy("mix_id")))
    t = targets.select("mix_id", "source", "target_share", "max_repeats")
    return t.join(per, ["mix_id", "source"], "left").select(
        "mix_id", "source", "target_share", (F.col("target_share") / F.sum("target_share").over(Window.partitionBy("mix_id"))).alias("scaled_share"),
        F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), "max_repeats",
    )
