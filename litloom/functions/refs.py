"""Cited references: parsing, canonical keys and labels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_null(c: Column) -> Column:
    return F.when(c != "", c)


def doi_or_arxiv(text: Column) -> Column:
    """[P18] DOI or arXiv id of a reference in lower case; dots, then ')', then ']' at its end are cut, in this order."""
    d = F.lower(F.regexp_extract(text, r"(?i)10\.\d{4,9}/[^\s,;\]\[]+", 0))
    d = F.regexp_replace(F.regexp_replace(F.regexp_replace(d, r"\.+$", ""), r"\)+$", ""), r"\]+$", "")
    arxiv = F.regexp_extract(text, r"(?i)arxiv[:\s]*(\d{4}\.\d{4,5})", 1)
    return F.coalesce(_or_null(d), F.when(arxiv != "", F.concat(F.lit("arxiv:"), arxiv)))


def wos_reference(line: Column) -> Column:
    """[P19] ``raw, doi, year, first_author, token`` of a WoS line; all but raw may be null."""
    raw = F.trim(line)
    parts = F.transform(F.split(raw, ","), lambda p: F.trim(p))
    second, third = F.get(parts, F.lit(1)), F.get(parts, F.lit(2))
    year = F.when(second.rlike(r"^(19|20)\d{2}$"), second).otherwise(_or_null(F.regexp_extract(raw, r"\b((?:19|20)\d{2})\b", 1)))
    return F.struct(
        raw.alias("raw"),
        doi_or_arxiv(raw).alias("doi"),
        year.cast("int").alias("year"),
        _or_null(F.lower(F.element_at(F.split(F.get(parts, F.lit(0)), r"\s+"), 1))).alias("first_author"),
        third.alias("token"),
    )


def scopus_segments(text: Column) -> Column:
    """[P20] The references of a ';' string: a piece opens a new one if it starts like an author (``Smith J``)."""
    got = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p)), lambda p: p != "")
    empty = F.array().cast("array<string>")

    def fold(acc: Column, p: Column) -> Column:
        n = F.size(acc)
        longer = F.concat(F.slice(acc, F.lit(1), n - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("; "), p)))
        return F.when((n == 0) | p.rlike(r"^[A-Z][a-z]+\s+[A-Z]"), F.concat(acc, F.array(p))).otherwise(longer)

    return F.aggregate(got, empty, fold)


def scopus_reference(raw: Column) -> Column:
    """[P21] ``raw, doi, year, first_author, token`` of one Scopus reference."""
    parts = F.slice(F.transform(F.split(raw, ","), lambda p: F.trim(p)), 2, 3)
    title = F.filter(parts, lambda p: (F.length(p) > 20) & ~p.rlike(r"^\d+$") & ~p.contains("pp."))
    return F.struct(
        raw.alias("raw"),
        doi_or_arxiv(raw).alias("doi"),
        _or_null(F.regexp_extract(raw, r"\((\d{4})\)", 1)).cast("int").alias("year"),
        _or_null(F.trim(F.regexp_extract(raw, r"^([A-Z][a-z]+(?:\s+[A-Z]\.?(?:\s*[A-Z]\.?)*)?)", 1))).alias("first_author"),
        F.substring(F.get(title, F.lit(0)), 1, 100).alias("token"),
    )


def cited_key(ref: Column) -> Column:
    """[P22] ``doi:...``, else ``ay:surname|year|up to three words``; null without a DOI or surname and year."""
    author = F.regexp_replace(F.lower(F.coalesce(ref["first_author"], F.lit(""))), "[^a-z]", "")
    words = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(ref["token"], F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+"), lambda w: w != "")
    tail = F.when(F.size(words) > 0, F.concat(F.lit("|"), F.array_join(F.slice(words, 1, 3), " "))).otherwise("")
    return F.when(ref["doi"].isNotNull(), F.concat(F.lit("doi:"), ref["doi"])).when(
        (author != "") & ref["year"].isNotNull(), F.concat(F.lit("ay:"), author, F.lit("|"), ref["year"].cast("string"), tail)
    )


def reference_label(ref: Column) -> Column:
    """[P23] ``Author (year)``, or the beginning of the raw text."""
    name = F.regexp_replace(F.coalesce(ref["first_author"], F.lit("")), r"\s+", " ")
    # Every run of letters begins in upper case, also after a hyphen.
    runs = F.regexp_extract_all(name, F.lit(r"[A-Za-zÀ-ÿ]+|[^A-Za-zÀ-ÿ]+"), F.lit(0))
    title = F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), "")
    year = F.coalesce(ref["year"].cast("string"), F.lit(""))
    return F.when((title != "") | (year != ""), F.concat(title, F.lit(" ("), year, F.lit(")"))).otherwise(F.substring(ref["raw"], 1, 40))


def wos_references(lines: Column) -> Column:
    """[P24] Parsed references of an array of lines."""
    return F.transform(F.coalesce(lines, F.array().cast("array<string>")), wos_reference)


def scopus_references(text: Column) -> Column:
    """[P24] Parsed references of a string."""
    return F.transform(scopus_segments(text), scopus_reference)


def references_of(source: Column, lines: Column, text: Column) -> Column:
    """[P25] The parser that fits the row: lines of WoS rows that have any, else the string."""
    return F.when((source == "WoS") & (F.size(lines) > 0), wos_references(lines)).otherwise(scopus_references(text))


def cited_keys(references: Column) -> Column:
    """[P24] Keys in order, repeats kept, references without a key left out."""
    return F.filter(F.transform(references, cited_key), lambda k: k.isNotNull())


def reference_chunks(text: Column) -> Column:
    """[P26] A Scopus string cut after each ``(year);``."""
    return F.split(F.coalesce(text, F.lit("")), r"(?<=\(\d{4}\));\s*")


def short_name(name: Column) -> Column:
    """[P27] ``Gehrmann Sebastian`` as ``Gehrmann S.``."""
    return F.regexp_replace(name, r"^(\S+)\s+([A-Z])[a-z]+$", "$1 $2.")


def chunk_label(chunk: Column) -> Column:
    """[P27] ``First A. (year)`` of a chunk, null where either is missing or the name is too long."""
    name = short_name(F.trim(F.element_at(F.split(chunk, "[;,]"), 1)))
    year = F.regexp_extract(chunk, r"\((\d{4})\)\s*$", 1)
    return F.when((F.length(name) > 0) & (F.length(name) <= 40) & (year != ""), F.concat(name, F.lit(" ("), year, F.lit(")")))


def display_label(key: Column, first_author: Column, stored: Column) -> Column:
    """[P28] First author's label, else the stored one, else what the key itself says."""
    parts = F.split(F.substr(key, F.lit(4)), r"\|")
    year = F.get(parts, F.lit(1))
    own = F.initcap(F.get(parts, F.lit(0)))
    from_key = (
        F.when(key.startswith("doi:"), F.substring(F.substr(key, F.lit(5)), 1, 40))
        .when(key.startswith("ay:") & year.rlike(r"^\d+$"), F.concat(own, F.lit(" ("), year, F.lit(")")))
        .when(key.startswith("ay:"), own)
        .otherwise(F.substring(key, 1, 40))
    )
    return F.coalesce(first_author, F.when(F.trim(stored) != "", stored), from_key)
