import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litloom.functions import refs, text


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_numbers(spark):
    d = spark.createDataFrame([(v,) for v in ["12", " 3.7 ", "12d", "", None, "NaN", "1e3", "-"]], "x string")
    got = [r[0] for r in d.select(text.number(F.col("x"))).collect()]
    assert got == [12.0, 3.7, None, None, None, None, 1000.0, None]
    assert [r[0] for r in d.select(text.count_or_zero(F.col("x"))).collect()] == [12, 3, 0, 0, 0, 0, 1000, 0]


def test_pieces_and_flags(spark):
    assert one(spark, " a; ;B;a", text.pieces) == ["a", "B", "a"]
    assert one(spark, None, text.pieces) == [] and one(spark, "A;b", text.pieces_lower) == ["a", "b"]
    assert one(spark, "[No abstract available]", text.has_abstract) is False and one(spark, "", text.has_abstract) is True
    assert one(spark, " ", text.has_text) is False and one(spark, None, text.has_text) is False


def test_countries_and_institutions(spark):
    a = "Dept, Univ One, Town, Peoples R China; Univ Two (UK), England.; Solo; Lab, 12345; Univ Three, GA 31061 USA; MIT, USA"
    assert one(spark, a, text.countries) == ["China", "GA 31061 USA", "Solo", "United Kingdom", "United States"]
    assert one(spark, a, text.institutions) == ["Dept", "Univ Three", "Univ Two (UK)"]
    assert one(spark, None, text.countries) == []


def test_identity_keys(spark):
    assert one(spark, " The  Title: A/B! ", text.title_key) == "the title a b" and one(spark, "The-Title 2", text.title_compact) == "thetitle2"
    assert one(spark, "https://doi.org/10.1234/AbC.5.", text.doi_found) == "10.1234/abc.5" and one(spark, "none", text.doi_found) == ""
    assert one(spark, "DOI:10.1/X", text.doi_stripped) == "10.1/x" and one(spark, "https://doi.org/doi:10.1/x", text.doi_stripped) == "10.1/x"
    d = spark.createDataFrame([("10.1234/a", "T", 1), (None, "Same Title", 2), (None, None, 3)], "d string, t string, i long")
    assert [r[0] for r in d.select(text.dedup_key(F.col("d"), F.col("t"), F.col("i"))).collect()] == ["doi:10.1234/a", "ttl:same title", "row:3"]


def test_tokens_and_ngrams(spark):
    assert one(spark, "The Cats-and dogs ran, 42 x", text.tokens) == ["catsand", "dogs", "ran"]
    assert one(spark, ["a", "b", "c"], lambda c: text.ngrams(c, 2), "array<string>") == ["a b", "b c"]
    assert one(spark, ["a"], lambda c: text.ngrams(c, 2), "array<string>") == []


def test_ids_labels_exposure(spark):
    assert one(spark, 7, text.padded_id, "int") == "P007" and one(spark, 12345, text.padded_id, "int") == "P12345"
    assert one(spark, "Su, Zhao (571)", text.clean_name) == "Su, Zhao" and one(spark, "English; French", text.primary_language) == "English"
    assert one(spark, None, text.primary_language) == "(unspecified)"
    assert abs(one(spark, 2026, text.publication_midpoint, "int") - (2026 + 153 / 730)) < 1e-9 and one(spark, 2024, text.publication_midpoint, "int") == 2024.5


def test_doi_cut_in_order(spark):
    assert one(spark, "see 10.1234/x.) end", refs.doi_or_arxiv) == "10.1234/x."  # dots first, then brackets
    assert one(spark, "arXiv: 2301.12345", refs.doi_or_arxiv) == "arxiv:2301.12345" and one(spark, "nothing", refs.doi_or_arxiv) is None


def test_wos_line(spark):
    r = one(spark, "Smith-Lee J, 2010, J TEST, V5, DOI [10.1234/a, 10.1234/B]", refs.wos_reference)
    assert (r["doi"], r["year"], r["first_author"], r["token"]) == ("10.1234/a", 2010, "smith-lee", "J TEST")
    key = lambda s: one(spark, s, lambda c: refs.cited_key(refs.wos_reference(c)))
    assert key("Smith J, 2010, J. TEST of Many Words") == "ay:smith|2010|j test of" and key("Smith") is None and key("X, about 1999 or so") == "ay:x|1999"


def scopus_fold(s):
    out, cur = [], ""
    for p in (x.strip(" ") for x in s.split(";")):
        if not p:
            continue
        if cur and re.match(r"[A-Z][a-z]+\s+[A-Z]", p, re.A):
            out.append(cur)
            cur = p
        else:
            cur = f"{cur}; {p}" if cur else p
    return out + [cur] if cur else out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from(["Smith J., T one", "de Boer", "Title (2010)", "", " Lee K", "lower", "Ab Cd, x"]), max_size=8))
def test_segments_match_a_plain_fold(spark, parts):
    s = ";".join(parts)
    assert one(spark, s, refs.scopus_segments) == scopus_fold(s)


def test_scopus_reference_and_labels(spark):
    s = "Smith J., A rather long title of the work, Journal, 4, pp. 1-2, (2010)"
    r = one(spark, s, refs.scopus_reference)
    assert (r["year"], r["first_author"], r["token"]) == (2010, "Smith J.", "A rather long title of the work")
    assert one(spark, s, lambda c: refs.reference_label(refs.scopus_reference(c))) == "Smith J. (2010)"
    assert one(spark, "A B (2010); C D (2011)", refs.reference_chunks) == ["A B (2010)", "C D (2011)"]
    assert one(spark, "Gehrmann Sebastian", refs.short_name) == "Gehrmann S."


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=30))
def test_normalisers_are_idempotent(spark, s):
    d = spark.createDataFrame([(s,)], "x string")
    for f in (text.title_key, text.title_compact, text.doi_found):
        once = d.select(f(F.col("x")).alias("x"))
        assert once.select(f(F.col("x"))).first()[0] == once.first()[0]
