"""The typed knowledge graph of a corpus: ten kinds of nodes, eleven relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from litloom.functions import text
from litloom.operators import pairs

# Terms looked for in keywords.
TECHNOLOGIES = (
    "chatgpt", "gpt", "bert", "transformer", "deep learning", "machine learning", "neural network", "nlp",
    "natural language processing", "large language model", "llm", "turnitin", "generative ai", "artificial intelligence",
)
METHODS = (
    "text similarity", "cosine similarity", "plagiarism detection", "text mining", "sentiment analysis", "classification",
    "clustering", "semantic analysis", "feature extraction", "topic modeling",
)


def _named(prefix: str, c: Column, n: int | None = None) -> Column:
    return F.concat(F.lit(prefix), (F.substring(c, 1, n) if n else c).cast("string"))


def _keywords(corpus: DataFrame) -> DataFrame:
    """Keywords in two papers or more, one row per paper and keyword."""
    k = corpus.select("record_id", F.explode("all_kw").alias("kw"))
    return pairs.supported(k, "kw", 2)


def nodes(corpus: DataFrame, topics: DataFrame | None = None, id_length: int = 40) -> DataFrame:
    """[G6] ``id, type, label, year, cited_by``; an id occurs once.

    ``corpus`` has derived fields; ``topics`` (topic, label) leaves out -1.
    Institutions and venues are cut to ``id_length`` letters, so that long
    names with the same beginning are one node.
    """
    c = F.col
    none = [F.lit(None).cast("int").alias("year"), F.lit(None).cast("int").alias("cited_by")]

    def kind(d: DataFrame, prefix: str, name: str, type_: str, label: Column | None = None, n: int | None = None) -> DataFrame:
        value = F.substring(c(name), 1, n) if n else c(name).cast("string")
        return d.filter(c(name).isNotNull()).select(_named(prefix, c(name), n).alias("id"), F.lit(type_).alias("type"), (label if label is not None else value).alias("label"), *none).dropDuplicates(["id"])

    each = lambda col: corpus.select(F.explode(col).alias("x"))
    authors = pairs.first_names(corpus, "author_id_list", "author_list", "record_id").filter("id <> ''")
    terms = corpus.select(F.explode("all_kw").alias("x"))
    parts = [
        corpus.select(_named("", c("record_id")).alias("id"), F.lit("Paper").alias("type"), F.substring("title", 1, 60).alias("label"), c("year"), c("cites").alias("cited_by")),
        authors.select(_named("A_", c("id")).alias("id"), F.lit("Author").alias("type"), text.clean_name(c("name")).alias("label"), *none),
        kind(each("institution_list"), "I_", "x", "Institution", n=id_length),
        kind(each("country_list"), "C_", "x", "Country"),
        kind(_keywords(corpus), "K_", "kw", "Keyword"),
        kind(pairs.mentions(terms, "x", TECHNOLOGIES), "Tech_", "term", "Technology"),
        kind(pairs.mentions(terms, "x", METHODS), "M_", "term", "Method"),
        kind(corpus, "V_", "source_title", "Venue", n=id_length),
        kind(corpus, "Y_", "year", "Year"),
    ]
    if topics is not None:
        parts.append(kind(topics.filter("topic >= 0"), "T_", "topic", "Topic", F.substring("label", 1, id_length)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edges(corpus: DataFrame, assigned: DataFrame | None = None, id_length: int = 40) -> DataFrame:
    """[G7, J11, J13, J14] ``src, dst, relation`` as a bag; only LOCATED_IN is kept once per pair."""
    c = F.col
    paper = _named("", c("record_id"))

    def rel(d: DataFrame, src: Column, dst: Column, name: str) -> DataFrame:
        return d.select(src.alias("src"), dst.alias("dst"), F.lit(name).alias("relation"))

    def exploded(col: str) -> DataFrame:
        return corpus.select("record_id", F.explode(col).alias("x"))

    kws, terms = _keywords(corpus), exploded("all_kw")
    inst, own = F.substring("b", 1, id_length), F.substring("a", 1, id_length)
    two = pairs.ordered_pairs(corpus, "author_id_list")
    lists = kws.groupBy("record_id").agg(F.array_sort(F.collect_set("kw")).alias("k"))
    parts = [
        rel(exploded("author_id_list"), paper, _named("A_", c("x")), "AUTHORED_BY"),
        rel(corpus.filter(c("source_title").isNotNull()), paper, _named("V_", c("source_title"), id_length), "PUBLISHED_IN"),
        rel(corpus, paper, _named("Y_", c("year")), "PUBLISHED_IN_YEAR"),
        rel(kws, paper, _named("K_", c("kw")), "USES_KEYWORD"),
        rel(pairs.mentions(terms, "x", TECHNOLOGIES), paper, _named("Tech_", c("term")), "MENTIONS_TECHNOLOGY"),
        rel(pairs.mentions(terms, "x", METHODS), paper, _named("M_", c("term")), "USES_METHOD"),
        rel(pairs.per_row_product(corpus, "record_id", "author_id_list", "institution_list"), _named("A_", c("a")), F.concat(F.lit("I_"), inst), "AFFILIATED_WITH"),
        rel(pairs.per_row_product(corpus, "record_id", "institution_list", "country_list"), F.concat(F.lit("I_"), own), _named("C_", c("b")), "LOCATED_IN").distinct(),
        rel(pairs.ordered_pairs(lists, "k"), _named("K_", c("a")), _named("K_", c("b")), "CO_OCCURS_WITH"),
        rel(two, _named("A_", c("a")), _named("A_", c("b")), "COLLABORATES_WITH"),
    ]
    if assigned is not None:
        parts.append(rel(assigned.filter("topic >= 0"), paper, _named("T_", c("topic")), "HAS_TOPIC"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_edges(bag: DataFrame) -> DataFrame:
    """[K7] One edge per ordered pair: the relation first in alphabetical order."""
    w = Window.partitionBy("src", "dst").orderBy("relation")
    return bag.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
