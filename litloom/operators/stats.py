"""Descriptive statistics, crosstabs, rankings and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(rows: DataFrame, by: str, name: str = "n") -> DataFrame:
    """[A7, A8, A20, A27, A29, A33] Rows per value; nulls are left out."""
    return rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias(name))


def item_frequencies(rows: DataFrame, items: str, name: str = "n") -> DataFrame:
    """[A10, A11, M21] Occurrences per item of an array column, repeats counted."""
    return rows.select(F.explode(items).alias("item")).groupBy("item").agg(F.count("*").alias(name))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """[T1-T4, A8] The first k rows in an order that ends in a unique key."""
    return rows.orderBy(*order).limit(k)


def top_per_group(rows: DataFrame, by: str, k: int, *order: Column) -> DataFrame:
    """[W1, W4, T7] The first k rows of every group, with their rank.

    Spark keeps k rows per group on each side of the shuffle (window group
    limit), so a hot group moves k rows per task.
    """
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def percentiles(rows: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """[A12-A14] Exact percentiles of a number per group, interpolated between neighbours, named as in ``shares``.

    Rows become counts of distinct values first; then a running total within
    the group finds the places.  Nothing is held in memory per group.  Nulls
    do not count; a group without a number has nulls where ``by`` is None, no
    row otherwise.
    """
    by = by or []
    n = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    n = n.withColumn("_upto", F.sum("_n").over(w.orderBy("_v"))).withColumn("_all", F.sum("_n").over(w))
    out = []
    for name, share in shares.items():
        place = F.lit(float(share)) * (F.col("_all") - 1)
        at = lambda k: F.min(F.when(F.col("_upto") > k, F.col("_v")))
        out.append((at(F.floor(place)) + (at(F.ceil(place)) - at(F.floor(place))) * F.max(place - F.floor(place))).alias(name))
    return n.groupBy(*by).agg(*out) if by else n.agg(*out)


def summary(rows: DataFrame, value: str) -> DataFrame:
    """[A12, A13] n, mean, median, deviation, minimum, quartiles, maximum and zeros of a number; exact percentiles."""
    v = F.col(value)
    one = rows.agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high"), F.count_if(v == 0).alias("zeros"))
    q = percentiles(rows, value, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return one.join(F.broadcast(q), F.lit(True)).select("n", "mean", "std", "low", "q25", "median", "q75", "high", "zeros")  # single rows


def group_summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """[A14, A15, A38] Rows, mean, median, sum and range per group; a null group is one of its own."""
    v = F.col(value)
    d = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.sum(v).cast("double").alias("total"), F.min(v).cast("double").alias("low"), F.max(v).cast("double").alias("high"))
    m = percentiles(rows, value, {"median": 0.5}, [by]).withColumnRenamed(by, "_by")
    return d.join(m, F.col(by).eqNullSafe(F.col("_by")), "left").select(by, "n", "mean", "median", "total", "low", "high")


def crosstab(rows: DataFrame, row: str, column: str, labels: list, row_labels: list | None = None) -> DataFrame:
    """[A16-A18, M11] Counts per row value and label, zeros filled; ``row_labels`` fixes the rows."""
    d = rows.groupBy(row).pivot(column, labels).agg(F.count(F.lit(1)))
    if row_labels is not None:
        fixed = rows.sparkSession.createDataFrame([(x,) for x in row_labels], f"{row} {dict(rows.dtypes)[row]}")
        d = fixed.join(d, row, "left")
    return d.fillna(0, [str(x) for x in labels])


def cell_shares(rows: DataFrame, a: str, b: str) -> DataFrame:
    """[A19, W6] Count and percentage of all rows per cell."""
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    whole = rows.agg(F.count("*").alias("_all"))
    return n.join(F.broadcast(whole), F.lit(True)).select(a, b, "n", (F.col("n") * 100.0 / F.col("_all")).alias("percent"))  # one row


def concentration(counts: DataFrame, n: str = "n") -> DataFrame:
    """[A25] Herfindahl-Hirschman index of counts: the sum of squared shares, in two sums."""
    t = F.col(n).cast("double")
    return counts.agg((F.sum(t * t) / (F.sum(t) * F.sum(t))).alias("hhi"), F.count("*").alias("categories"))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """[A9, A12, A21, A39-A41] One row of counts over a corpus with derived fields."""
    distinct = lambda c: corpus.select(F.explode(c).alias("x")).agg(F.count_distinct("x").alias(f"n_{c}"))
    one = corpus.agg(
        F.count("*").alias("n_papers"),
        F.count_if("has_abstract").alias("with_abstract"),
        F.count_if("has_references").alias("with_references"),
        F.count("author_keywords").alias("with_author_keywords"),
        F.count_if("is_oa").alias("open_access"),
        F.count_distinct("source_title").alias("n_venues"),
        F.sum("cites").alias("citations"),
        F.count_if(F.col("cites") == 0).alias("uncited"),
    )
    for c in ("author_id_list", "country_list", "institution_list", "all_kw"):
        one = one.join(F.broadcast(distinct(c)), F.lit(True))  # single rows
    return one


def reference_counts(rows: DataFrame, keys: str = "ref_keys") -> DataFrame:
    """[A40, A41] ``n_papers, with_refs, total_refs, distinct_works`` of an array column of keys; a null array has none."""
    n = F.greatest(F.coalesce(F.size(keys), F.lit(0)), F.lit(0))
    one = rows.agg(F.count("*").alias("n_papers"), F.count_if(n > 0).alias("with_refs"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_refs"))
    return one.join(F.broadcast(rows.select(F.explode(keys).alias("x")).agg(F.count_distinct("x").alias("distinct_works"))), F.lit(True))  # single rows


def team_sizes(rows: DataFrame, size: str = "author_count") -> DataFrame:
    """[A37] Rows per team size: 1, 2-3, 4+."""
    n = F.col(size)
    band = F.when(n <= 0, "none").when(n == 1, "1").when(n <= 3, "2-3").otherwise("4+")
    return rows.groupBy(band.alias("team")).agg(F.count("*").alias("n"))


def median_split(rows: DataFrame, a: str, b: str, names: tuple[str, str, str, str] = ("motor", "niche", "basic/transversal", "emerging/declining")) -> DataFrame:
    """[W5, G19] ``quadrant`` by the medians of two columns; a median itself counts as high."""
    m = percentiles(rows, a, {"_ma": 0.5}).join(F.broadcast(percentiles(rows, b, {"_mb": 0.5})), F.lit(True))
    d = rows.join(F.broadcast(m), F.lit(True))  # one row
    ha, hb = F.col(a) >= F.col("_ma"), F.col(b) >= F.col("_mb")
    return d.withColumn("quadrant", F.when(ha & hb, names[0]).when(hb, names[1]).when(ha, names[2]).otherwise(names[3])).drop("_ma", "_mb")


def search(rows: DataFrame, term: str, *columns: str) -> DataFrame:
    """Rows of which a column contains the term, in any case; a blank term finds nothing."""
    low = term.strip().lower()
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(low), F.lit(False))
    return rows.filter(hit) if low else rows.limit(0)


def distinct_in_order(rows: DataFrame, column: str) -> DataFrame:
    """[T8, T9] The distinct values of a column in order, nulls left out."""
    return rows.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)
