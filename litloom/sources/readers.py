"""Readers of bibliographic formats.

Every reader declares its schema; none infers one.  Files are the unit of
distribution for formats that need sequential parsing.
"""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Canonical columns and the headings of tabular exports.
HEADINGS = {
    "title": "Title", "pub_year": "Year", "abstract": "Abstract", "author_full_names": "Author full names", "author_ids": "Author(s) ID",
    "author_keywords": "Author Keywords", "index_keywords": "Index Keywords", "affiliations": "Affiliations", "open_access": "Open Access",
    "document_type": "Document Type", "cited_by": "Cited by", "doi": "DOI", "references_text": "References", "source_title": "Source title",
    "orig_language": "Language of Original Document",
}
CANONICAL = [*[c for c in HEADINGS if c != "orig_language"], "cr_list", "source_db"]
LIST_TAGS = ("AU", "AF", "CR", "C1")  # tags whose lines are items of their own
CODING = "paper_id string, orientation string, methodology string, confidence string, note string"
ENRICHED = "doi string, title string, authors string, pub_year string, document_type string, source_title string, standardized_keywords string, research_categories string, cited_by string, quality_score string, quality_tier string"


def read_tabular(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """[S1, S2, S3] A quoted CSV export with a header, as canonical string columns; columns the file lacks are null.

    ``columns`` prunes; asking for one the file lacks raises.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"').csv(path)
    names = {v: k for k, v in HEADINGS.items()}
    d = raw.select(*[F.col(f"`{c}`").cast("string").alias(names.get(c, c)) for c in raw.columns])
    if columns is not None:
        missing = [c for c in columns if c not in d.columns]
        if missing:
            raise ValueError(f"columns absent from the export: {missing}")
        return d.select(*columns)
    return canonical(d, "Scopus")


def canonical(rows: DataFrame, source: str) -> DataFrame:
    """[S3] The canonical columns in their order, defaults for missing ones."""
    kinds = {"cr_list": "array<string>"}
    have = set(rows.columns)
    cols = [F.lit(source).alias(c) if c == "source_db" else (F.col(c) if c in have else F.lit(None).cast(kinds.get(c, "string")).alias(c)) for c in CANONICAL]
    return rows.select(*cols)


def parse_tagged(content: str) -> Iterator[dict[str, list[str]]]:
    """Records of field-tagged text: two-letter tags, three blanks continue, PT opens, ER closes, EF ends."""
    record: dict[str, list[str]] | None = None
    tag = ""
    for line in content.lstrip("﻿").splitlines():
        head = line[:2]
        if head == "EF":
            break
        if not line.strip() or (record is None and head in ("FN", "VR")):
            continue
        if head == "ER":
            if record:
                yield record
            record, tag = None, ""
        elif line.startswith("   ") and tag and record is not None:
            record[tag].append(line.strip())
        elif re.match(r"[A-Z][A-Z0-9](?: |$)", line):
            if record is None:
                record = {}
            tag = head
            record.setdefault(tag, []).append(line[3:].strip())
    if record:
        yield record


class TaggedReader(DataSourceReader):
    """One partition per file; files are opened through Arrow, by path or URI (a local path, hdfs, s3 ...)."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]

    def partitions(self):
        return [InputPartition((i, p)) for i, p in enumerate(self.paths)]

    def read(self, partition):
        from pyarrow import fs

        i, path = partition.value
        files, at = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", re.sub("^file:/*", "file:///", path))) if ":" in path else (fs.LocalFileSystem(), path)
        with files.open_input_stream(at) as f:
            content = f.read().decode("utf-8-sig", "replace")
        for j, r in enumerate(parse_tagged(content)):
            yield (i, path, j, {k: [v for v in vs if v] for k, vs in r.items()})


class TaggedSource(DataSource):
    """[S4] ``spark.read.format("tagged")``: one partition per file; rows ``file_no, file, row_no, tags``."""

    @classmethod
    def name(cls):
        return "tagged"

    def schema(self):
        return "file_no int, file string, row_no int, tags map<string,array<string>>"

    def reader(self, schema: StructType):
        return TaggedReader(dict(self.options))


def read_tagged(spark: SparkSession, paths: str) -> DataFrame:
    """[S4, S6] Field-tagged files by a glob, in the order of their names: ``file, row_no, tags``.

    Files are read whole, each by one task, from any file system Spark reads.
    """

    def parse(parts):
        import pandas as pd

        for pdf in parts:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                for j, r in enumerate(parse_tagged(bytes(content).decode("utf-8", "replace"))):
                    rows.append((path, j, {k: [v for v in vs if v] for k, vs in r.items()}))
            yield pd.DataFrame(rows, columns=["file", "row_no", "tags"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(parse, "file string, row_no int, tags map<string,array<string>>")


def tagged_rows(records: DataFrame) -> DataFrame:
    """[S5, S6] Canonical rows of tagged records; records without a title are left out."""
    many = lambda t: F.coalesce(F.try_element_at("tags", F.lit(t)), F.array().cast("array<string>"))
    text = lambda t: F.nullif(F.trim(F.array_join(many(t), " ")), F.lit(""))
    names = F.when(F.size(many("AF")) > 0, many("AF")).otherwise(many("AU"))
    bare = F.transform(many("C1"), lambda x: F.trim(F.regexp_replace(x, r"^\[[^\]]*\]\s*", "")))
    c3 = F.filter(F.transform(F.split(F.coalesce(text("C3"), F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    digits = lambda c, rx: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), rx, 0), F.lit(""))
    cites = F.coalesce(digits(F.coalesce(text("TC"), text("Z9"), F.lit("0")), r"\d+"), F.lit("0"))
    ids = F.transform(names, lambda n: F.regexp_replace(F.lower(F.trim(n)), r"\s+", " "))
    return records.filter(text("TI").isNotNull()).select(
        "file", "row_no",
        text("TI").alias("title"), digits(text("PY"), r"\d{4}").alias("pub_year"),
        F.coalesce(text("AB"), F.lit("[No abstract available]")).alias("abstract"),
        F.array_join(names, "; ").alias("author_full_names"), F.array_join(ids, "; ").alias("author_ids"),
        F.coalesce(text("DE"), F.lit("")).alias("author_keywords"), F.coalesce(text("ID"), F.lit("")).alias("index_keywords"),
        F.array_join(F.when(F.size(many("C1")) > 0, bare).otherwise(c3), "; ").alias("affiliations"),
        F.coalesce(text("OA"), F.lit("")).alias("open_access"), F.coalesce(text("DT"), F.lit("")).alias("document_type"),
        cites.alias("cited_by"), F.coalesce(text("DI"), F.lit("")).alias("doi"),
        F.array_join(many("CR"), "; ").alias("references_text"), F.coalesce(text("SO"), F.lit("")).alias("source_title"),
        many("CR").alias("cr_list"), F.coalesce(text("UT"), F.lit("")).alias("wos_ut"), F.lit("WoS").alias("source_db"),
    )


def read_codings(spark: SparkSession, paths: str) -> DataFrame:
    """[S7] JSON arrays of codings; of a paper in several files the last file's row stays."""
    d = spark.read.schema(CODING).option("multiLine", True).json(paths).withColumn("_f", F.col("_metadata.file_path"))
    w = Window.partitionBy("paper_id").orderBy(F.desc("_f"))
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_f")


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """[S8] One JSON document per file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """[S9] ``paper_id, topic``."""
    return spark.read.schema("paper_id string, topic int").option("header", True).csv(path)


def read_through(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """[S10, S11] The parquet table at ``path``; it is built and written first where it is missing or ``force`` is set."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if force or not fs.exists(at):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


WORKS = "meta struct<count:long,next_cursor:string>, results array<struct<id:string,doi:string,title:string,type:string,publication_year:int,primary_location:struct<source:struct<display_name:string>>>>"


def fetch(url: str, timeout: float = 45, retries: int = 3, backoff: float = 8, opener: Callable = urllib.request.urlopen, wait: Callable = time.sleep) -> bytes:
    """[S13] The body of a URL; waits backoff, 2 x backoff ... between tries."""
    for i in range(retries):
        try:
            with opener(url, timeout=timeout) as r:
                return r.read()
        except OSError:
            if i == retries - 1:
                raise
            wait(backoff * (i + 1))
    raise ValueError("retries must be positive")


def works_pages(base: str, where: str, most: int = 1000, per_page: int = 200, get: Callable[[str], bytes] = fetch) -> Iterator[dict]:
    """[S12] Pages of a cursor interface; the cap is checked per page, an empty page ends."""
    cursor, n = "*", 0
    while cursor and n < most:
        q = urllib.parse.quote(where, safe=":,|")
        page = json.loads(get(f"{base}?filter={q}&per-page={per_page}&cursor={urllib.parse.quote(cursor)}"))
        if not page.get("results"):
            if n == 0:
                yield page
            return
        n += len(page["results"])
        yield page
        cursor = (page.get("meta") or {}).get("next_cursor")


def works(spark: SparkSession, paths: str) -> DataFrame:
    """[S12] Works of recorded pages (JSON files): ``id, doi, title, type, year, venue, total``."""
    d = spark.read.schema(WORKS).option("multiLine", True).json(paths)
    r = d.select("meta.count", F.explode("results").alias("r"))
    return r.select("r.id", "r.doi", "r.title", "r.type", F.col("r.publication_year").alias("year"), F.col("r.primary_location.source.display_name").alias("venue"), F.col("count").alias("total"))


def probed(spark: SparkSession, probes: dict[str, Callable[[], float]]) -> DataFrame:
    """[K10] ``name, status, value, error``: a probe that fails leaves its error instead of stopping the others."""
    rows = []
    for name, run in probes.items():
        try:
            rows.append((name, "ok", float(run()), None))
        except Exception as e:  # noqa: BLE001 - any failure is recorded
            rows.append((name, "error", None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "name string, status string, value double, error string")


def read_bibtex(spark: SparkSession, paths: str) -> DataFrame:
    """[S14] ``file, kind, cite_key, fields``: records of BibTeX files, split in the JVM."""
    d = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.explode(F.regexp_extract_all("value", F.lit(r"(?ms)^@(\w+\{.*?^\})"), F.lit(1))).alias("r"))
    pairs = F.regexp_extract_all("r", F.lit(r"(?ms)^\s*(\w+)\s*=\s*\{.*?\}\s*,?\s*$"), F.lit(0))
    names = F.transform(pairs, lambda p: F.lower(F.regexp_extract(p, r"(\w+)\s*=", 1)))
    values = F.transform(pairs, lambda p: F.regexp_extract(p, r"(?s)=\s*\{(.*)\}\s*,?\s*$", 1))
    distinct = F.map_from_entries(F.filter(F.transform(F.arrays_zip(names.alias("k"), values.alias("v")), lambda x: F.struct(x["k"], x["v"])), lambda x: x["k"] != ""))
    return d.select("file", F.upper(F.regexp_extract("r", r"^(\w+)\{", 1)).alias("kind"), F.regexp_extract("r", r"^\w+\{\s*([^,\s]+)", 1).alias("cite_key"), distinct.alias("fields"))


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    """[S15] The eleven columns of an enriched export, by position."""
    return spark.read.schema(ENRICHED).option("header", True).option("escape", '"').csv(path)


def read_lines(spark: SparkSession, paths: str) -> DataFrame:
    """[S16] Lines of free text with their file."""
    return spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def graph_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """[S8, S17] Nodes and edges of a hand-made graph document; its own statistics are ignored."""
    s = "nodes array<struct<id:string,label:string,type:string>>, edges array<struct<source:string,target:string,weight:int,type:string>>"
    d = read_document(spark, path, s)
    n = d.select(F.explode("nodes").alias("x")).select("x.id", "x.label", "x.type")
    e = d.select(F.explode("edges").alias("x")).select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.weight", F.col("x.type").alias("relation"))
    return n, e


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """[S17] Arrays written in a page, as a frame; a row shorter than the schema ends in nulls, a longer one is refused."""
    n = len(spark.createDataFrame([], schema).columns)
    if any(len(r) > n for r in rows):
        raise ValueError(f"a row has more than {n} values")
    return spark.createDataFrame([(*r, *[None] * (n - len(r))) for r in rows], schema)
