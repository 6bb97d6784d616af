"""Filling containers of fixed capacity by vector best-fit.

Every container has three capacities: tokens, documents and attention cost
(the sum of squared lengths).  Items come in descending length, all containers
stay open, and each item selects, of those whose three residuals hold it, the
container with the best score: the least weighted norm of the residuals it
leaves, or the largest weighted dot product of residual and demand.  Where none
holds it, a container is opened.

Documents are spread over blocks of bounded size by a hash of their id; each
block is packed by one task.  A block's open end costs at most one container.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WEIGHTS = (1.0, 0.05, 0.05)  # tokens, documents, attention cost


class Bins:
    """Open containers: residual tokens, documents and attention cost, and the lengths they hold."""

    def __init__(self, capacity: int, max_docs: int, max_cost: float, rule: str, weights):
        self.full = np.array([capacity, max_docs, max_cost], float)
        self.rule, self.weights = rule, np.array(weights, float)
        self.caps, self.ways = self.full.tolist(), self.weights.tolist()
        self.rest = np.empty((1024, 3))
        self.held: list[list[int]] = []
        self.open = np.array([], int)

    def score(self, at: np.ndarray, n: int) -> np.ndarray:
        """Of containers ``at``, lower is better; infinite where ``n`` doesn't fit every residual."""
        need = np.array([n, 1.0, float(n) * n])
        rest = self.rest[at]
        if self.rule == "dot":
            s = -((rest / self.full) * (need / self.full) * self.weights).sum(axis=1)
        else:
            s = ((((rest - need) / self.full) ** 2) * self.weights).sum(axis=1)
        return np.where((rest >= need).all(axis=1), s, np.inf)

    def put(self, b: int, n: int) -> float:
        """``n`` goes into container ``b``; the score for one more of that length."""
        self.held[b].append(n)
        rest, square = self.rest[b], float(n) * n
        t, d, a = float(rest[0]) - n, float(rest[1]) - 1.0, float(rest[2]) - square
        rest[0], rest[1], rest[2] = t, d, a
        if t < n or d < 1.0 or a < square:
            return math.inf
        (ft, fd, fa), (wt, wd, wa) = self.caps, self.ways
        if self.rule == "dot":
            return -((t / ft) * (n / ft) * wt + (d / fd) * (1.0 / fd) * wd + (a / fa) * (square / fa) * wa)
        x, y, z = (t - n) / ft, (d - 1.0) / fd, (a - square) / fa
        return x * x * wt + y * y * wd + z * z * wa

    def new(self) -> int:
        b = len(self.held)
        if b == len(self.rest):
            self.rest = np.concatenate([self.rest, np.empty_like(self.rest)])
        self.held.append([])
        self.rest[b] = self.full
        return b

    def place(self, n: int, count: int, least: int) -> None:
        """``count`` items of length ``n``, one after the other; ``least`` is the shortest length still to come."""
        self.open = self.open[(self.rest[self.open] >= (least, 1.0, float(least) * least)).all(axis=1)]
        scores = self.score(self.open, n)
        # Equal items change one container at a time: only its score is computed anew,
        # and of the others the best ``count`` are all that can be taken.
        best = np.argsort(scores, kind="stable")[:count]
        heap = [(float(scores[i]), int(self.open[i])) for i in best if scores[i] < np.inf]
        fresh = []
        for _ in range(count):
            if heap:
                b = heapq.heappop(heap)[1]
            else:
                b = self.new()  # a first piece always fits
                fresh.append(b)
            s = self.put(b, n)
            if s < math.inf:
                heapq.heappush(heap, (s, b))
        self.open = np.concatenate([self.open, np.array(fresh, int)])


def pack_lengths(counts: dict[int, int], capacity: int, max_docs: int, max_cost: float, rule: str = "residual", weights=WEIGHTS) -> list[list[int]]:
    """Containers as lists of lengths; every length is at most ``capacity``."""
    lengths = sorted((n for n, c in counts.items() if c), reverse=True)
    bins = Bins(capacity, max_docs, max_cost, rule, weights)
    for n in lengths:
        bins.place(n, counts[n], lengths[-1])
    return bins.held


def _limits(capacity: int, docs_per_token: float, cost_share: float) -> tuple[int, float]:
    """Documents and attention cost that a container of ``capacity`` tokens may hold."""
    return max(1, int(capacity * docs_per_token)), max(1.0, cost_share * capacity * capacity)


def _pack_block(rule: str, docs_per_token: float, cost_share: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity = int(pdf["capacity"].iloc[0])
        block, pack = int(pdf["block"].iloc[0]), int(pdf["pack_id"].iloc[0])
        pdf = pdf.sort_values(["n_tokens", "id"], ascending=[False, True], kind="stable")
        waiting: dict[int, list] = {}
        rows, box = [], 0
        for i, n in zip(pdf["id"].tolist(), pdf["n_tokens"].tolist()):
            start = 0
            while n - start > capacity:  # only a text longer than the capacity is split
                rows.append((pack, (block << 32) + box, i, start // capacity, start, capacity))
                start, box = start + capacity, box + 1
            waiting.setdefault(n - start, []).append((i, start))
        for lengths in pack_lengths({n: len(v) for n, v in waiting.items()}, capacity, *_limits(capacity, docs_per_token, cost_share), rule):
            for n in lengths:
                i, start = waiting[n].pop()
                rows.append((pack, (block << 32) + box, i, start // capacity, start, n))
            box += 1
        return pd.DataFrame(rows, columns=["pack_id", "container_id", "id", "piece", "start_token", "n_tokens"])

    return run


DOCS_PER_TOKEN, COST_SHARE = 1 / 64, 0.9  # of a container: a document for 64 tokens, 0.9 of the attention cost of a single text that fills it


def pack(
    sizes: DataFrame,
    capacities: list[tuple[int, int]],
    key: str = "doc_id",
    n_tokens: str = "n_tokens",
    block_rows: int = 20_000,
    rule: str = "residual",
    docs_per_token: float = DOCS_PER_TOKEN,
    cost_share: float = COST_SHARE,
) -> DataFrame:
    """``pack_id, container_id, key, piece, start_token, n_tokens``: one row per piece.

    ``sizes`` has a unique key and a size per row; ``capacities`` are (pack_id,
    tokens).  A text is whole (piece 0) unless it alone exceeds the capacity:
    then it gives full pieces and one rest.  Texts of no tokens (null, empty)
    take no room and have no row.  Equal sizes are taken in the order of their
    keys; an empty table or no capacity gives no row; extra columns are
    ignored.  A container holds at most ``docs_per_token`` x capacity pieces
    (one at least) and ``cost_share`` x capacity^2 of attention cost; a first
    piece always fits.  With both at 1.0 tokens alone decide.
    """
    spark = sizes.sparkSession
    kind = dict(sizes.dtypes)[key]
    schema = f"pack_id int, container_id long, id {kind}, piece long, start_token long, n_tokens long"
    good = [(int(p), int(c)) for p, c in capacities if c and c > 0]
    if not good:
        return spark.createDataFrame([], schema).withColumnRenamed("id", key)
    n = sizes.count()
    blocks = max(1, math.ceil(n / block_rows))
    each = F.array(*[F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in good])
    d = sizes.filter(F.col(n_tokens) > 0).select(
        F.col(key).alias("id"), F.col(n_tokens).cast("long").alias("n_tokens"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), F.explode(each).alias("c")
    )
    d = d.select("id", "n_tokens", "block", "c.pack_id", "c.capacity")
    got = d.groupBy("pack_id", "block").applyInPandas(_pack_block(rule, docs_per_token, cost_share), schema)
    return got.withColumnRenamed("id", key)


def packing_report(packed: DataFrame, capacities: list[tuple[int, int]], docs_per_token: float = DOCS_PER_TOKEN, cost_share: float = COST_SHARE) -> DataFrame:
    """Per pack: containers, pieces, tokens, the filled share of each capacity, containers at their limit of documents or cost, and the bound no packing can beat.

    A container is at its limit of cost where a further piece of its unused tokens' length would exceed it.
    """
    caps = packed.sparkSession.createDataFrame(
        [(int(p), int(c), *_limits(int(c), docs_per_token, cost_share)) for p, c in capacities if c and c > 0], "pack_id int, capacity_tokens long, most_docs long, most_cost double"
    )
    c = F.col
    each = packed.groupBy("pack_id", "container_id").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("t"), F.sum(c("n_tokens").cast("double") * c("n_tokens")).alias("cost"))
    each = each.join(F.broadcast(caps), "pack_id")
    unused = c("capacity_tokens") - c("t")
    full_docs = (unused > 0) & (c("docs") >= c("most_docs"))
    full_cost = (unused > 0) & (c("cost") + unused * unused > c("most_cost"))
    d = each.groupBy("pack_id", "capacity_tokens", "most_docs", "most_cost").agg(
        F.count("*").alias("n_containers"), F.sum("docs").alias("n_pieces"), F.sum("t").alias("tokens"), F.sum("cost").alias("cost"),
        F.count_if(full_docs).alias("at_most_docs"), F.count_if(full_cost).alias("at_most_cost"),
    )
    return d.select(
        "pack_id", "capacity_tokens", "n_containers", "n_pieces", "tokens",
        (c("tokens") / (c("n_containers") * c("capacity_tokens"))).alias("fill_share"),
        (c("n_pieces") / (c("n_containers") * c("most_docs"))).alias("docs_share"),
        (c("cost") / (c("n_containers") * c("most_cost"))).alias("cost_share"),
        "at_most_docs", "at_most_cost",
        F.ceil(c("tokens") / c("capacity_tokens")).alias("least_containers"),
    )
