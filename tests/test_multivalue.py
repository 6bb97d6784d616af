import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litloom.operators.multivalue import Dialect, add_values, infer_delimiters, infer_dialects, split_values, values

KEYWORDS = Dialect((";", "|", "\n", "·"), (",",))
NAMES = Dialect((";", "|", "\n", "&", "and"))
REFS = Dialect((";", "|", "\n"), (), True)


def cut(spark, texts, dialect):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, t string")
    rows = split_values(d, "k", "t", dialects={"": dialect}).collect()
    out = {i: [] for i in range(len(texts))}
    for r in sorted(rows, key=lambda r: (r["k"], r["pos"])):
        out[r["k"]].append(r["val"])
        assert r["pos"] == len(out[r["k"]])
    return [out[i] for i in range(len(texts))]


def test_quotes_blanks_empties(spark):
    got = cut(spark, ['a; b | c;d', '"x; y" ; z', '; ;a;;', '"so-called ""humanizers"""; b', None, "", "  ", '"only"', "a\tb"], KEYWORDS)
    assert got == [["a", "b", "c", "d"], ["x; y", "z"], ["a"], ['so-called "humanizers"', "b"], [], [], [], ["only"], ["a\tb"]]


def test_weak_comma_only_without_strong(spark):
    texts = ["a, b, c", "policy, national; x", "policy, national | y", "policy, national", "p, q", 'm, "ethics, institutional", n']
    got = cut(spark, texts, KEYWORDS)
    assert got[0] == ["a", "b", "c"] and got[1] == ["policy, national", "x"]
    assert got[3] == ["policy, national"]  # seen whole beside strong delimiters
    assert got[4] == ["p", "q"] and got[5] == ["m", "ethics, institutional", "n"]


def test_names_with_words_between(spark):
    got = cut(spark, ["Anders, Bo & Candy, Al", 'A, B and "Lab; Unit (5)"', "Sand, Rand"], NAMES)
    assert got == [["Anders, Bo", "Candy, Al"], ["A, B", "Lab; Unit (5)"], ["Sand, Rand"]]


def test_brackets_stay(spark):
    got = cut(spark, ["[A, B; C, D] Univ X, City; Univ Y, Town"], Dialect((";", "|")))
    assert got == [["[A, B; C, D] Univ X, City", "Univ Y, Town"]]


def test_references_keep_authors_and_titles(spark):
    a = "Smith J.; Jones K.B., A title on things; evidence from two cohorts, Journal, 4, pp. 1-2, (2010)"
    b = "de Vries T., Other, Annals, (2011)"
    w = "Gozak M, 1998, ANN ACAD PUBL; delSini G, 2014, P ZIR, DOI [10.1/a, 10.1/B]"
    got = cut(spark, [f"{a}; {b}", f"{a} | {b}", w, f'"{a}"\n{b};'], REFS)
    assert got[0] == [a, b] and got[1] == [a, b] and got[3] == [a, b]
    assert got[2] == ["Gozak M, 1998, ANN ACAD PUBL", "delSini G, 2014, P ZIR, DOI [10.1/a, 10.1/B]"]


def test_long_text_and_repeats(spark):
    long = ";".join(f"value {i}" for i in range(20000))
    got = cut(spark, [long, "a;a;a"], KEYWORDS)
    assert len(got[0]) == 20000 and got[1] == ["a", "a", "a"]


def test_inference_finds_the_source_s_own(spark):
    rows = [("x", "; ".join(f"word{j} term" for j in range(2 + i % 3))) for i in range(40)] + [("x", "single term") for _ in range(40)]
    rows += [("y", " | ".join(f"Ab{j}, Cd" for j in range(2 + i % 3))) for i in range(40)] + [("y", "Ab, Cd") for _ in range(40)]
    got = infer_delimiters(spark.createDataFrame(rows, "s string, t string"), "t", "s")
    assert got["x"].strong == (";",) and got["y"].strong == ("|",) and got["y"].weak == ()


def test_empty_table_and_clashing_names(spark):
    d = spark.createDataFrame([], "k long, t string, val string, pos int, _k int")
    assert split_values(d, "k", "t").count() == 0
    e = spark.createDataFrame([(1, "a;b", "own", 7, 3)], "k long, t string, val string, pos int, _v int")
    assert [r["val"] for r in split_values(e, "k", "t", dialects={"": KEYWORDS}).collect()] == ["a", "b"]
    kept = add_values(e, {"t": "parts"}, dialects={"t": {"": KEYWORDS}}).first()
    assert kept["parts"] == ["a", "b"] and kept["val"] == "own"


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("abc ,.()é", min_size=1, max_size=8).filter(lambda s: s.strip()), min_size=1, max_size=6))
def test_round_trip_of_quoted_values(spark, vals):
    vals = [re.sub(r"\s+", " ", v).strip() for v in vals]
    packed = "; ".join('"' + v.replace('"', '""') + '"' for v in vals)
    d = spark.createDataFrame([(packed,)], "t string").select(values(F.col("t"), KEYWORDS).alias("v"))
    assert d.first()["v"] == vals


def test_all_values_of_the_small_tables(spark, sf):
    from litloom.plans.packed import p3_found

    d = p3_found(spark, sf)
    assert d.columns == ["record_id", "field_name", "pos", "val"]
    assert d.filter("val = '' or val is null or pos < 1").count() == 0
    assert d.groupBy("record_id", "field_name", "pos").count().filter("count > 1").count() == 0


def test_one_scan_infers_all_fields(spark):
    rows = [(i, "S" if i % 2 else "T", "; ".join(f"Name {i}, Al" for _ in range(3)), " | ".join(f"word {k}" for k in range(4))) for i in range(40)] + [(99, None, None, "")]
    d = spark.createDataFrame(rows, "k long, s string, a string, b string")
    how = infer_dialects(d, ["a", "b"], "s")
    assert how == {"a": infer_delimiters(d, "a", "s"), "b": infer_delimiters(d, "b", "s")}
    assert how["a"]["S"].strong == (";",) and how["b"]["T"].strong == ("|",)
    got = add_values(d, {"a": "x", "b": "y"}, "s").filter("k < 99")
    assert {(len(r["x"]), len(r["y"])) for r in got.collect()} == {(3, 4)}
