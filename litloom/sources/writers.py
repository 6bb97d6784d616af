"""Writers: tables, result documents and GraphML."""

from __future__ import annotations

import json
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_ROWS = 1_000_000  # rows that a document written by the driver may have


def write_table(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """[K1, K4, K5] Parquet, replaced as a whole."""
    w = rows.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """[K2] CSV with a header, of the columns that exist."""
    w = rows.select(*[c for c in columns if c in rows.columns]).write.mode("overwrite").option("header", True).option("escape", '"')
    w.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _rows(d: DataFrame) -> list:
    got = d.limit(MOST_ROWS + 1).collect()
    if len(got) > MOST_ROWS:
        raise ValueError(f"a document takes at most {MOST_ROWS} rows; write a table instead")
    return got


def write_text(spark: SparkSession, path: str, content: str) -> None:
    """One document of the driver's, on any file system Spark writes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(content.encode("utf-8")))
    finally:
        out.close()


def write_document(path: str, parts: dict[str, DataFrame]) -> None:
    """[K3] Small frames as one JSON document; values JSON lacks become text."""
    spark = next(iter(parts.values())).sparkSession
    write_text(spark, path, json.dumps({k: [r.asDict(recursive=True) for r in _rows(d)] for k, d in parts.items()}, indent=1, default=str))


def write_graphml(path: str, vertices: DataFrame, edges: DataFrame) -> None:
    """[K6] A simple graph as GraphML; every further column is an attribute, written as text."""
    vs, es = _rows(vertices), _rows(edges)
    va = [c for c in vertices.columns if c != "id"]
    ea = [c for c in edges.columns if c not in ("src", "dst")]
    out = ['<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n']
    for kind, names in (("node", va), ("edge", ea)):
        out += [f'<key id="{kind[0]}_{c}" for="{kind}" attr.name={quoteattr(c)} attr.type="string"/>\n' for c in names]
    out.append('<graph edgedefault="undirected">\n')

    def data(r, names, kind):
        return "".join(f'<data key="{kind}_{c}">{escape(str(r[c]))}</data>' for c in names if r[c] is not None)

    out += [f"<node id={quoteattr(str(r['id']))}>{data(r, va, 'n')}</node>\n" for r in vs]
    out += [f"<edge source={quoteattr(str(r['src']))} target={quoteattr(str(r['dst']))}>{data(r, ea, 'e')}</edge>\n" for r in es]
    write_text(vertices.sparkSession, path, "".join([*out, "</graph>\n</graphml>\n"]))


def show(rows: DataFrame, n: int = 20, *order) -> None:
    """[K9] The first n rows on the console."""
    (rows.orderBy(*order) if order else rows).show(n, truncate=False)


def plot_data(rows: DataFrame, year: str, partial_year: int = 2026) -> DataFrame:
    """[K8, P40] The frame behind a figure over years, with the year marked that was observed in part."""
    return rows.withColumn("partial", F.col(year) == partial_year)
