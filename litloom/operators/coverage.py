"""Coverage probes: overlap with target sets, tool mentions, language and preprint shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.functions import text

# Tools and general terms looked for.
TOOLS = (
    "Turnitin", "GPTZero", "ZeroGPT", "Originality.ai", "Copyleaks", "iThenticate", "QuillBot", "Crossref Similarity Check",
    "DetectGPT", "Grammarly", "Compilatio", "Urkund", "PlagScan",
)
GENERAL_TERMS = (
    "artificial intelligence", "generative ai", "large language model", "machine learning", "deep learning", "chatgpt", "llm",
    "neural network", "natural language processing",
)


def key_sets(*tables: DataFrame) -> DataFrame:
    """[J6, U3] Distinct ``kind, key`` (doi, title) of several tables together."""
    out = None
    for d in tables:
        part = d.select(F.explode(F.array(F.struct(F.lit("doi").alias("kind"), text.doi_stripped(F.col("doi")).alias("key")), F.struct(F.lit("title").alias("kind"), text.title_compact(F.col("title")).alias("key")))).alias("x")).select("x.*")
        out = part if out is None else out.unionByName(part)
    return out.filter("key <> ''").distinct()


def overlap(found: DataFrame, core: DataFrame, extended: DataFrame) -> DataFrame:
    """[J5] ``n, in_core, in_extended, core_share``: works whose DOI or title key is in the sets; share null for none."""
    d = found.select(text.doi_stripped(F.col("doi")).alias("d"), text.title_compact(F.col("title")).alias("t"))
    for name, keys in (("core", core), ("ext", extended)):
        by_doi = keys.filter("kind = 'doi'").select(F.col("key").alias("d"), F.lit(True).alias(f"{name}_d"))
        by_title = keys.filter("kind = 'title'").select(F.col("key").alias("t"), F.lit(True).alias(f"{name}_t"))
        d = d.join(by_doi, "d", "left").join(by_title, "t", "left")
    hit = lambda n: F.coalesce(F.col(f"{n}_d"), F.lit(False)) | F.coalesce(F.col(f"{n}_t"), F.lit(False))
    s = d.agg(F.count("*").alias("n"), F.count_if(hit("core")).alias("in_core"), F.count_if(hit("ext")).alias("in_extended"))
    return s.withColumn("core_share", F.col("in_core") / F.nullif(F.col("n"), F.lit(0)))


def tool_mentions(rows: DataFrame, tools=TOOLS, general=GENERAL_TERMS) -> DataFrame:
    """[A26, A28, F13] One row: papers, papers naming a tool, those without a general term, their share (null for none), and a count per tool."""
    t = text.screen_text(F.col("title"), F.col("abstract"), F.col("author_keywords"), F.col("index_keywords"))
    d = rows.select(t.alias("t"))
    hits = [F.col("t").contains(x.lower()) for x in tools]
    named = hits[0]
    for h in hits[1:]:
        named = named | h
    lacks = named & ~text.any_term(F.col("t"), general)
    name = lambda x: "tool_" + "".join(ch if ch.isalnum() else "_" for ch in x.lower())
    s = d.agg(F.count("*").alias("papers"), F.count_if(named).alias("naming_a_tool"), F.count_if(lacks).alias("without_general_term"), *[F.count_if(h).alias(name(x)) for x, h in zip(tools, hits, strict=True)])
    return s.withColumn("share_without", F.col("without_general_term") / F.nullif(F.col("naming_a_tool"), F.lit(0)))


def languages(rows: DataFrame, language: str = "orig_language") -> DataFrame:
    """[A27, P33] Rows per first language."""
    return rows.select(text.primary_language(F.col(language)).alias("language")).groupBy("language").agg(F.count("*").alias("n"))


def language_share(rows: DataFrame, language: str = "orig_language") -> DataFrame:
    """[A27] ``n, english, non_english_share``; the share is null for no rows."""
    e = F.lower(text.primary_language(F.col(language))) == "english"
    s = rows.agg(F.count("*").alias("n"), F.count_if(e).alias("english"))
    return s.withColumn("non_english_share", (F.col("n") - F.col("english")) / F.nullif(F.col("n"), F.lit(0)))


def type_share(rows: DataFrame, kind: str, value: str) -> DataFrame:
    """[A30] ``n, matching, share`` of one type; null share for no rows."""
    s = rows.agg(F.count("*").alias("n"), F.count_if(F.col(kind) == value).alias("matching"))
    return s.withColumn("share", F.col("matching") / F.nullif(F.col("n"), F.lit(0)))
