"""Agreement of two coders, merged codings, crosstabs and cluster purity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paired(a: DataFrame, b: DataFrame, key: str, label: str) -> DataFrame:
    """[J15, U5] ``key, a, b`` of the items both coded."""
    return a.select(key, F.col(label).alias("a")).join(b.select(key, F.col(label).alias("b")), key)


def kappa(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """[A22, A23] ``n, agreement, kappa``: one row.

    ``agreement`` compares all pairs; for kappa pairs off the label list count
    in n but not in the matrix.  kappa is null for no pairs or where chance
    agreement is 1.
    """
    ok = F.col("a").isin(*labels) & F.col("b").isin(*labels)
    cols = [F.count("*").alias("n"), F.avg(F.coalesce((F.col("a") == F.col("b")).cast("double"), F.lit(0.0))).alias("agreement"), F.count_if(ok & (F.col("a") == F.col("b"))).alias("same")]
    for i, v in enumerate(labels):
        cols += [F.count_if(ok & (F.col("a") == v)).alias(f"a{i}"), F.count_if(ok & (F.col("b") == v)).alias(f"b{i}")]
    d = pairs.agg(*cols)
    n = F.col("n").cast("double")
    pe = sum((F.col(f"a{i}") * F.col(f"b{i}") for i in range(len(labels))), F.lit(0)) / F.nullif(n * n, F.lit(0.0))
    po = F.col("same") / F.nullif(n, F.lit(0.0))
    return d.select("n", "agreement", F.when(F.abs(1 - pe) > 1e-8, (po - pe) / (1 - pe)).alias("kappa"))


def confusion(pairs: DataFrame, labels: list[str]) -> DataFrame:
    """[A22] Counts of b's labels per label of a."""
    fixed = pairs.sparkSession.createDataFrame([(v,) for v in labels], "a string")
    return fixed.join(pairs.groupBy("a").pivot("b", labels).agg(F.count(F.lit(1))), "a", "left").fillna(0, labels)


def disagreements(a: DataFrame, b: DataFrame, key: str, dims: list[str]) -> DataFrame:
    """Items where any dimension differs; null differs from a label."""
    j = a.select(key, *[F.col(d).alias(f"{d}_a") for d in dims]).join(b.select(key, *[F.col(d).alias(f"{d}_b") for d in dims]), key)
    differ = F.lit(False)
    for d in dims:
        differ = differ | ~F.col(f"{d}_a").eqNullSafe(F.col(f"{d}_b"))
    return j.filter(differ)


def merged(first: DataFrame, rest: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """[J16] All items of both; the first coder's row wins where there is one."""
    f = first.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns], F.lit(True).alias("_f"))
    r = rest.select(key, *columns)
    j = f.join(r, key, "full")
    return j.select(key, *[F.when(F.col("_f"), F.col(f"_f_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def looked_up(items: DataFrame, codes: DataFrame, clusters: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """[J17, J18] Items with their codes, cluster and the cluster's label (cluster list is short); missing ones null."""
    return items.join(codes, key, "left").join(clusters, key, "left").join(F.broadcast(names), "cluster", "left")


def comparable(rows: DataFrame, cluster: str, code: str) -> DataFrame:
    """Rows with a known cluster and a code."""
    return rows.filter(F.col(cluster).isNotNull() & F.col(code).isNotNull())


def impurity(rows: DataFrame, cluster: str, label: str) -> DataFrame:
    """[A24, A32] ``cluster, size, top_label, impurity``: one minus the largest label's share; ties by label."""
    n = rows.groupBy(cluster, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(cluster)
    d = n.withColumn("size", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), label)))
    return d.filter("r = 1").select(cluster, "size", F.col(label).alias("top_label"), (1 - F.col("n") / F.col("size")).alias("impurity"))


def label_votes(rows: DataFrame, key: str, label: str) -> DataFrame:
    """[A32] The most frequent label of every key; ties by label."""
    n = rows.filter(F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    return n.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(label).alias("l"))).alias("b")).select(key, F.col("b.l").alias(label))
