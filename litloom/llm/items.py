"""Items of papers: keywords and references as they are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litloom.operators.multivalue import add_values
from litloom.runtime import collapse

KEYWORD_FIELDS = ("author_keywords", "index_keywords")


def _items(values):
    return F.filter(F.transform(values, lambda v: collapse(v)), lambda v: v != "")


def paper_items(papers: DataFrame, references: bool = True) -> DataFrame:
    """``record_id, keywords, references``: items of both keyword fields in one array, and of the references; repeats kept.

    One scan infers the delimiters of all fields, one splits them.
    """
    fields = (*KEYWORD_FIELDS, "references_text") if references else KEYWORD_FIELDS
    d = add_values(papers.select("record_id", "source_db", *fields), {f: f"v{i}" for i, f in enumerate(fields)}, "source_db", ("references_text",))
    return d.select("record_id", _items(F.concat("v0", "v1")).alias("keywords"), *([_items(F.col("v2")).alias("references")] if references else []))


def keyword_items(papers: DataFrame) -> DataFrame:
    """``record_id, items``: keyword items of both fields in one array, repeats kept."""
    return paper_items(papers, False).withColumnRenamed("keywords", "items")
