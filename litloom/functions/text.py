"""Normalisers and derived fields as column expressions.

The bracketed names (P4, P8 ...) are the identifiers of the operator inventory.
All stay inside code generation; a null input gives the stated result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NO_ABSTRACT = "[No abstract available]"  # fixed value: the sentinel of the exports
PLAIN_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
# Country names as the databases write them, and the name they are led to.
COUNTRY_NAMES = {
    "peoples r china": "China",
    "china": "China",
    "taiwan": "Taiwan",
    "usa": "United States",
    "united states": "United States",
    "england": "United Kingdom",
    "scotland": "United Kingdom",
    "wales": "United Kingdom",
    "north ireland": "United Kingdom",
    "u arab emirates": "United Arab Emirates",
    "uae": "United Arab Emirates",
    "united arab emirates": "United Arab Emirates",
    "south korea": "South Korea",
    "korea": "South Korea",
    "republic of korea": "South Korea",
    "korea rep": "South Korea",
    "russia": "Russian Federation",
    "russian federation": "Russian Federation",
    "viet nam": "Vietnam",
    "vietnam": "Vietnam",
    "czech republic": "Czech Republic",
    "czechia": "Czech Republic",
    "saudi arabia": "Saudi Arabia",
    "hong kong": "Hong Kong",
    "turkiye": "Turkey",
    "turkey": "Turkey",
}
# Function words left out of token lists.
STOP_WORDS = (
    "the and for are was were has have had with from that this these those their its into than then but not "
    "our your his her they them she you who which what when where how all any both each few more most other "
    "some such only own same too very can will just should now also between through during before after above "
    "below out off over under again further once here there about against because until while does did doing "
    "would could may might been being"
).split()


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number(c: Column) -> Column:
    """[P1, P2] The number a text holds, else null: '12d' and 'NaN' are no numbers."""
    t = c.cast("string")
    return F.when(t.rlike(PLAIN_NUMBER), F.trim(t).try_cast("double"))


def count_or_zero(c: Column) -> Column:
    """[P1] A whole number, 0 where the text holds none."""
    return F.coalesce(F.floor(number(c)), F.lit(0)).cast("int")


def has_text(c: Column) -> Column:
    """[P3] Not null and not blank."""
    return c.isNotNull() & (F.trim(c) != "")


def has_abstract(c: Column) -> Column:
    """[P3] Not null and not the sentinel; an empty text counts as one."""
    return c.isNotNull() & (c != NO_ABSTRACT)


def pieces(c: Column, by: str = ";") -> Column:
    """[P4] Split, trimmed, without empty pieces; order and repeats kept; null gives an empty array."""
    return F.filter(F.transform(F.split(text_or_empty(c), by), lambda x: F.trim(x)), lambda x: x != "")


def pieces_lower(c: Column, by: str = ";") -> Column:
    """[P5] ``pieces`` in lower case."""
    return F.transform(pieces(c, by), lambda x: F.lower(x))


def union_sorted(a: Column, b: Column) -> Column:
    """[P6] The distinct values of two arrays in order."""
    return F.array_sort(F.array_union(a, b))


def country(name: Column) -> Column:
    """[P9] The common name of a country; unknown names stay, without a trailing dot."""
    bare = F.trim(F.regexp_replace(F.trim(name), r"\.$", ""))
    known = F.create_map(*[F.lit(x) for kv in COUNTRY_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(known, F.lower(bare)), F.trim(F.regexp_replace(F.trim(name), r"\.+$", "")))


def countries(affiliations: Column) -> Column:
    """[P8] Distinct countries of a ';' list: the last ',' token of each, without remarks in brackets."""
    last = F.transform(pieces(affiliations), lambda p: F.trim(F.element_at(F.split(p, ","), -1)))
    names = F.transform(last, lambda x: country(F.trim(F.regexp_replace(x, r"\s*\(.*?\)\s*", ""))))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: (F.length(x) > 1) & ~x.rlike(r"^\d+$"))))


def institutions(affiliations: Column) -> Column:
    """[P10] Distinct first tokens of affiliations with two tokens or more; names of up to three letters are left out."""
    many = F.filter(pieces(affiliations), lambda p: p.contains(","))
    names = F.transform(many, lambda p: F.trim(F.element_at(F.split(p, ","), 1)))
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: F.length(x) > 3)))


def title_key(c: Column) -> Column:
    """[P11] Lower-case letters, digits and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9 ]", " "), " +", " "))


def title_compact(c: Column) -> Column:
    """[P13] Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text_or_empty(c)), "[^a-z0-9]+", "")


def doi_found(c: Column) -> Column:
    """[P12] The first DOI in a text in lower case, without trailing dots; '' if none."""
    return F.regexp_replace(F.regexp_extract(F.lower(text_or_empty(c)), r"10\.\d{4,9}/\S+", 0), r"\.+$", "")


def doi_stripped(c: Column) -> Column:
    """[P14] Lower case without resolver prefixes, each removed once in this order."""
    t = F.lower(F.trim(text_or_empty(c)))
    for prefix in ("https://doi\\.org/", "http://doi\\.org/", "doi:"):
        t = F.regexp_replace(t, f"^{prefix}", "")
    return F.trim(t)


def dedup_key(doi: Column, title: Column, own: Column | None = None, title_length: int = 120) -> Column:
    """[P15] ``doi:`` with the DOI, else ``ttl:`` with the title's beginning; rows with neither keep ``own``, unmerged."""
    d, t = doi_found(doi), F.substring(title_key(title), 1, title_length)
    rest = F.concat(F.lit("row:"), own.cast("string")) if own is not None else F.lit("ttl:")
    return F.when(d != "", F.concat(F.lit("doi:"), d)).when(t != "", F.concat(F.lit("ttl:"), t)).otherwise(rest)


def author_pseudo_id(c: Column) -> Column:
    """[P16] Lower case with single spaces."""
    return F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")


def without_bracket(c: Column) -> Column:
    """[P17] An affiliation without the names in brackets before it."""
    return F.trim(F.regexp_replace(c, r"^\[[^\]]*\]\s*", ""))


def primary_language(c: Column) -> Column:
    """[P33] The first language named, or (unspecified)."""
    return F.trim(F.element_at(F.split(F.coalesce(c, F.lit("(unspecified)")), ";"), 1))


def tokens(c: Column, stop: Sequence[str] = STOP_WORDS, longer_than: int = 2) -> Column:
    """[P34] Lower-case words of a-z, without short and function words."""
    words = F.split(F.regexp_replace(F.lower(text_or_empty(c)), r"[^a-z\s]", ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > longer_than) & ~w.isin(*stop))


def ngrams(words: Column, n: int) -> Column:
    """[P35] Word n-grams, joined by a space."""
    m = F.greatest(F.size(words) - n + 1, F.lit(0))
    out = F.slice(words, F.lit(1), m)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(k), m), lambda a, b: F.concat_ws(" ", a, b))
    return out


def clean_name(c: Column) -> Column:
    """[P36] A name up to its first bracket, without commas at the end."""
    return F.trim(F.regexp_replace(F.trim(F.element_at(F.split(c, r"\("), 1)), ",+$", ""))


def truncated(c: Column, n: int) -> Column:
    """[P37] The first n characters."""
    return F.substring(c, 1, n)


def topic_label(topic: Column, words: Column, n: int = 3) -> Column:
    """[P39] ``T3: a, b, c``, or ``Topic 3`` without words."""
    return F.when(
        F.size(words) > 0, F.concat(F.lit("T"), topic.cast("string"), F.lit(": "), F.array_join(F.slice(words, 1, n), ", "))
    ).otherwise(F.concat(F.lit("Topic "), topic.cast("string")))


def is_partial_year(year: Column, partial: int = 2026) -> Column:
    """[P40] Marks the year that was observed in part; counts are never scaled."""
    return year == partial


def padded_id(n: Column, prefix: str = "P", width: int = 3) -> Column:
    """[P38] ``P001``; numbers longer than the width stay whole."""
    t = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0")))


def any_term(text: Column, terms: Sequence[str]) -> Column:
    """Whether a text contains one of the terms, as they are written (leading blanks count)."""
    out = F.lit(False)
    for t in terms:
        out = out | text.contains(t)
    return F.coalesce(out, F.lit(False))


def screen_text(*cols: Column) -> Column:
    """[F3, P32] Several fields as one lower-case text; nulls are empty."""
    return F.lower(F.concat_ws(" ", *[text_or_empty(c) for c in cols]))


def publication_midpoint(year: Column, partial_year: int = 2026, observed: float = 153.0 / 365.0) -> Column:
    """[P29] Decimal-year middle of a publication year's observed part."""
    return F.when(year >= partial_year, year + F.lit(observed / 2.0)).otherwise(year + F.lit(0.5))


def exposure_years(year: Column, search: float = 2026 + 153.0 / 365.0, least: float = 0.05) -> Column:
    """[P30] Years from the publication's middle to the search, at least ``least``."""
    return F.greatest(F.lit(search) - publication_midpoint(year), F.lit(least))
