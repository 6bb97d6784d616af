"""Consensus of several annotators by spectral reliability.

For every label the votes are centred by each annotator's own rate of that
label, so that chance agreement is zero: then E[x_c x_d] = r_c r_d for two
annotators c and d, and the leading eigenvector of the agreement matrix,
corrected for how much every annotator overlaps with the others, holds their
reliabilities.  The matrix is never formed: a power iteration multiplies it
with the current vector through the items, first to the eigenvector of unit
length, then, from its eigenvalue, to the scale at which each annotator's
agreement equals what the annotators they overlap with explain.  Both end at a
tolerance.  Reliabilities are signed, so that an annotator who swaps two labels
counts against them; they give each vote its weight as a log likelihood ratio.

An item's votes are brought together once, as one short array (at most one
entry per annotator); a step then joins them with the vector, which every task
holds, and moves only sums per annotator and label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from litloom.runtime import cut

MOST_CODERS = 1_000_000  # annotators whose rates and reliabilities every task holds: a few numbers each


def canonical_label(raw: Column, labels: list[str]) -> Column:
    """The label that a typed one stands for: equal, an abbreviation of three letters or more, or within two edits; else null."""
    t = F.regexp_replace(F.lower(raw), "[^a-z]", "")
    keys = [(v, "".join(ch for ch in v.lower() if "a" <= ch <= "z")) for v in labels]

    def only(hits: list[Column]) -> Column:
        """The label of the one hit; null for none or several."""
        n = sum((h.cast("int") for h in hits), F.lit(0))
        return F.when(n == 1, F.coalesce(*[F.when(h, v) for h, (v, _) in zip(hits, keys, strict=True)]))

    exact = only([t == k for _, k in keys])
    begins = only([(F.length(t) >= 3) & F.lit(k).startswith(t) for _, k in keys])
    near = only([(F.length(t) >= 5) & (F.levenshtein(F.lit(k), t, 2) >= 0) for _, k in keys])
    return F.coalesce(exact, begins, near)


def latest_votes(coding: DataFrame, item: str, coder: str, raw: dict[str, str], at: str, order: str, labels: dict[str, list[str]]) -> DataFrame:
    """``dim, item, coder, label``: each coder's latest usable label of an item and dim; label is null if none is usable.

    ``raw`` names the column of every dim; the codings are read and moved once
    for all of them.  Rows without an item are left out.
    """
    named = {f"_{i}": canonical_label(F.col(raw[dim]), labels[dim]) for i, dim in enumerate(raw)}
    d = coding.select(F.col(item).alias("item"), F.col(coder).alias("coder"), F.struct(F.col(at), F.col(order)).alias("rank"), *[v.alias(k) for k, v in named.items()]).filter("item is not null")
    d = d.groupBy("item", "coder").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("rank"))).alias(k) for k in named])
    each = F.explode(F.array(*[F.struct(F.lit(dim).alias("dim"), F.col(k).alias("label")) for dim, k in zip(raw, named, strict=True)]))
    return d.select("item", "coder", each.alias("x")).select("x.dim", "item", "coder", "x.label")


def _votes(batch: pa.RecordBatch, dims: list[str], k: int):
    """Of a batch of items: place of each item's dim, number of votes, and per vote its dim, coder and label."""
    size = pc.list_value_length(batch.column("codes")).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False)
    dim = pc.index_in(batch.column("dim"), value_set=pa.array(dims)).to_numpy(zero_copy_only=False).astype(np.int64)
    return dim, size, np.repeat(dim, size), codes // k, codes % k


def _item_sums(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of the votes' values per item; zero for items without a vote."""
    out = np.zeros((len(size), values.shape[1]))
    has = size > 0
    if has.any():
        start = np.r_[0, np.cumsum(size)[:-1]][has]
        out[has] = np.add.reduceat(values, start, axis=0)
    return out


def _product(lists: DataFrame, dims: list[str], m: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The agreement matrix times ``r``, per dim, annotator and label; what the others' squared entries sum to on the same items; and the overlap counts (items shared with anyone)."""
    shape = m.shape
    k = shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, mass, overlap = np.zeros(shape), np.zeros(shape), np.zeros(shape[:2])
        for batch in batches:
            _, size, d, c, label = _votes(batch, dims, k)
            if not len(c):
                continue
            x = -m[d, c]
            x[np.arange(len(c)), label] += 1
            v = r[d, c]
            s, q = _item_sums(v * x, size), _item_sums(v * v, size)
            at = np.repeat(np.arange(len(size)), size)
            # An item weighs once per vote, however many others voted: one with very many doesn't outweigh all the rest.
            share = (1.0 / np.maximum(size - 1, 1))[at][:, None]
            np.add.at(num, (d, c), x * (s[at] - v * x) * share)
            np.add.at(mass, (d, c), (q[at] - v * v) * share)
            np.add.at(overlap, (d, c), np.minimum(size[at] - 1.0, 1.0))
        flat = np.r_[num.ravel(), mass.ravel(), overlap.ravel()]
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["i", "v"])

    flat = np.zeros(2 * m.size + shape[0] * shape[1])
    for row in lists.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():  # a few numbers per annotator
        flat[row["i"]] = row["v"]
    return flat[: m.size].reshape(shape), flat[m.size : 2 * m.size].reshape(shape), flat[2 * m.size :].reshape(shape[:2])


def reliabilities(lists: DataFrame, dims: list[str], m: np.ndarray, tol: float = 1e-4, most_steps: int = 200) -> tuple[np.ndarray, int]:
    """Signed reliabilities per dim, annotator and label, and the steps taken.

    First the leading eigenvector (unit length, by products divided by the
    overlap counts), then steps that divide by the squared reliabilities of
    those an annotator overlaps with, averaged with the last vector so that
    they can't swing.  Annotators who share no item with others get 0.
    """
    unit = lambda v: v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-300)
    v = unit(np.ones(m.shape))
    steps = 0
    while True:
        num, mass, overlap = _product(lists, dims, m, v)
        new = unit(np.where(overlap[..., None] > 0, num / np.maximum(overlap[..., None], 1), 0.0))
        steps += 1
        done = np.abs(new - v).max(initial=0) < tol * 10 or steps >= most_steps
        if done:
            break
        v = (new + v) / 2 if (new * v).sum() < 0 else new
    # The multiple of the eigenvector that explains the agreement best.
    scale = np.sqrt(np.maximum((v * num).sum(axis=1) / np.maximum((v * v * mass).sum(axis=1), 1e-300), 0.0))
    r = v * scale[:, None, :]
    while steps < most_steps:
        num, mass, _ = _product(lists, dims, m, r)
        new = (r + np.where(mass > 1e-12, num / np.maximum(mass, 1e-12), 0.0)) / 2
        steps += 1
        moved = np.abs(new - r).max(initial=0)
        r = new
        if moved < tol:
            break
    return r, steps


def spectral_consensus(votes: DataFrame, labels: dict[str, list[str]], tol: float = 1e-4, most_steps: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Consensus, annotators and agreement of ``votes`` (dim, item, coder, label).

    Returns
    - ``dim, item, label, n_votes, agreement, confidence``: one row per item
      and dim, also where no vote is usable (then the likeliest label of all,
      agreement and confidence null).  Ties go to the label first in alphabetical order.
    - ``dim, coder, n_votes, reliability``: the mean over labels of the
      annotator's informedness (1 perfect, 0 chance, negative: misleading).
    - ``dim, n_pairs, observed, expected, kappa``: chance-corrected agreement
      of all pairs of votes on an item.
    Repeated votes of a coder on an item must be resolved before.  Labels off
    the list, null ones and those without a coder or a known dim do not count;
    an empty table gives three empty results.  Annotators are counted first:
    more than MOST_CODERS are refused, since every task holds their rates.
    """
    spark = votes.sparkSession
    names = {d: sorted(vs) for d, vs in labels.items()}
    dims, k = sorted(names), max(map(len, names.values()))
    place = F.lit(None).cast("int")
    for d in dims:
        for i, v in enumerate(names[d]):
            place = F.when((F.col("dim") == d) & (F.col("label") == v), i).otherwise(place)
    every = votes.filter(F.col("dim").isin(*dims) & F.col("item").isNotNull()).select("dim", "item", "coder", F.when(F.col("coder").isNotNull(), place).alias("l"))
    every = cut(every)
    tally = every.filter("l is not null").groupBy("dim", "coder", "l").agg(F.count("*").alias("n"))
    tally = tally.limit(MOST_CODERS * k * len(dims) + 1).collect()  # annotators x labels
    coders = sorted({r["coder"] for r in tally})
    if len(coders) > MOST_CODERS:
        raise ValueError(f"at most {MOST_CODERS} annotators: their rates are sent to every task")
    at = {c: i for i, c in enumerate(coders)}
    n = np.zeros((len(dims), max(1, len(coders)), k))
    for row in tally:
        n[dims.index(row["dim"]), at[row["coder"]], row["l"]] = row["n"]
    m = n / np.maximum(n.sum(axis=2, keepdims=True), 1)
    index = spark.createDataFrame(list(at.items()), f"coder {dict(every.dtypes)['coder']}, c int")
    code = F.when(F.col("l").isNotNull(), F.col("c") * k + F.col("l"))
    lists = cut(every.join(F.broadcast(index), "coder", "left").groupBy("dim", "item").agg(F.collect_list(code).alias("codes")))
    r, _ = reliabilities(lists, dims, m, tol, most_steps)

    # Priors: the label rates of the annotators, weighted by their reliability.
    real = np.array([[i < len(names[d]) for i in range(k)] for d in dims])
    weight = np.maximum(r, 1e-6) * n.sum(axis=2, keepdims=True)
    p = np.where(real, (weight * m).sum(axis=1) / np.maximum(weight.sum(axis=1), 1e-300), 0.0)
    p = np.where(real, p / np.maximum(p.sum(axis=1, keepdims=True), 1e-300), 0.0).clip(0.01, 0.99)
    sd = np.sqrt(p * (1 - p))
    j = (r / sd[:, None, :]).clip(-1, 1)
    hit, false = (m + (1 - p)[:, None, :] * j).clip(0.01, 0.99), (m - p[:, None, :] * j).clip(0.01, 0.99)
    yes, no = np.log(hit / false), np.log((1 - hit) / (1 - false))
    start = np.where(real, np.log(p / (1 - p)), -np.inf)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim, size, d, c, label = _votes(batch, dims, k)
            each = np.where(np.arange(k)[None, :] == label[:, None], yes[d, c], no[d, c]) if len(c) else np.zeros((0, k))
            score = start[dim] + _item_sums(each, size)
            best = np.argmax(np.round(score, 9), axis=1)  # the first of equal ones
            top = np.exp(np.minimum(score, 500.0))
            confidence = top[np.arange(len(best)), best] / np.maximum(top.sum(axis=1), 1e-300)
            same = _item_sums((label == np.repeat(best, size)).astype(float)[:, None], size)[:, 0]
            none = size == 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("dim"), batch.column("item"), pa.array([names[dims[a]][b] for a, b in zip(dim, best, strict=True)], pa.string()), pa.array(size), pa.array(same / np.maximum(size, 1), mask=none), pa.array(confidence, mask=none)],
                names=["dim", "item", "label", "n_votes", "agreement", "confidence"],
            )

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(dims), 2), np.int64)
        for batch in batches:
            dim, size, _, _, label = _votes(batch, dims, k)
            c = _item_sums(np.eye(k)[label] if len(label) else np.zeros((0, k)), size).astype(np.int64)
            np.add.at(total, dim, np.c_[(c * (c - 1)).sum(axis=1), size * (size - 1)])
        yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(total[:, 0]), pa.array(total[:, 1])], names=["dim", "same", "pairs"])

    out = lists.mapInArrow(decide, f"dim string, item {dict(every.dtypes)['item']}, label string, n_votes long, agreement double, confidence double")
    per = [(d, c, int(n[a, b].sum()), float(j[a, b, real[a]].mean())) for a, d in enumerate(dims) for b, c in enumerate(coders) if n[a, b].sum()]
    reliable = spark.createDataFrame(per, f"dim string, coder {dict(every.dtypes)['coder']}, n_votes long, reliability double")
    share = n.sum(axis=1) / np.maximum(n.sum(axis=(1, 2), keepdims=True)[:, 0], 1)
    expected = spark.createDataFrame([(d, float((share[a] ** 2).sum())) for a, d in enumerate(dims)], "dim string, expected double")
    seen = lists.mapInArrow(pairs, "dim string, same long, pairs long").groupBy("dim").agg(F.sum("same").alias("same"), F.sum("pairs").alias("pairs")).filter("pairs > 0")
    observed = F.col("same") / F.col("pairs")
    kappa = F.try_divide(observed - F.col("expected"), 1 - F.col("expected"))
    agreement = seen.join(F.broadcast(expected), "dim").select("dim", (F.col("pairs") / 2).cast("long").alias("n_pairs"), observed.alias("observed"), "expected", kappa.alias("kappa"))
    return out, reliable, agreement
