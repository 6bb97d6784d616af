import pytest

from litloom.llm import truncation

WHOLE = [
    "A full text. It ends well.", "Did it end? Yes!", 'He said “done.”', "An end with a value (p = 0.61).", "Ends here. (Smith & Lee, 2010)", "All said.\nKeywords: one; two; three",
    "All said.\n— The editors", "All said.\nKind regards\nAnna Bell", "All said.\n- one thing\n- two things", "All said. © 2010 The Authors", "All said.\nReceived 12 March; accepted 4 June 2009",
    "On Text reuse in law clinics", "Code clone: open repositories", "All said.</p>", "Table follows.\nTable 1 | a | b | c", "It took place in 2016.",
]
CUT = [
    "We saw that the much longer text was cut in the midd", "The result (Smith", "According to “the pla", "We went on…", "We went on [...]", "We went on [more]", "Benchmark to lab reports &am", "Costs fell, i.", "The share grew to 31.", "A broken end � is �",
    "We present a thing, which", "He led them \"to", "<p>Open and we",
]


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    marks, broken, kind, *_ = truncation.inspect(text)
    assert kind in ("sentence", "closing", "heading") and not broken


@pytest.mark.parametrize("text", CUT)
def test_cut(text):
    marks, broken, kind, *_ = truncation.inspect(text)
    assert broken or kind in ("none", "ellipsis") or (marks and kind == "heading")


def test_table(spark):
    rows = [(i, f"Text number {i} is whole. It ends.", "s") for i in range(60)] + [(100 + i, t, "s") for i, t in enumerate(CUT)]
    rows += [(200 + i, f"Other words {i} came. And so the debate goes on...", "s") for i in range(6)] + [(300, None, "s"), (301, "", "s"), (302, "  ", None), (303, "Null source goes on for many more words until it is cu", None), (304, "Null source is fine.", None), (305, "So is this.", None)]
    rows += [(400 + i, f"entry {i} of a list without stops", "lists") for i in range(30)]
    d = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, open int, kind string")
    found = truncation.truncated(d)
    cut = {r["doc_id"] for r in found.filter("cut").collect()}
    assert {100 + i: t for i, t in enumerate(CUT) if 100 + i not in cut} == {}
    assert found.count() == len(rows) and {100 + i for i in range(len(CUT))} <= cut and 303 in cut
    assert not cut & ({*range(60)} | {*range(200, 206)} | {300, 301, 302, 304, 305} | {*range(400, 430)})  # lists never end in a stop
    report = {r["source"]: r for r in truncation.truncation_report(found).collect()}
    assert report["s"]["n_cut"] == len(CUT) and report[None]["n_cut"] == 1 and report["lists"]["cut_share"] == 0.0


def test_field_limit(spark):
    rows = [(i, ("word " * 40 + chr(97 + i % 26) * 5)[:100], "s") for i in range(12)] + [(50 + i, "Whole sentence here. " * (i % 7 + 1) + "End.", "s") for i in range(60)]
    got = truncation.truncated(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["doc_id"] for r in got if r["reason"] == "field limit"} == set(range(12)) and {r["field_limit"] for r in got} == {100}


def test_long_and_empty(spark):
    assert truncation.inspect("(" * 5000 + "a" * 100000)[0] == 5000
    assert truncation.truncated(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_ends_found_without_the_automaton_are_sentences(spark):
    from pyspark.sql import functions as F

    words = ["This ends here", "see Prof", "it is approx", "[cont", "one (more", "e.g.thing", "no", "über Größe", "the year 2020", "", "x" * 5000]
    tails = [".", "!", "...", ".)", '."', ".  \n", ".</p>", "", "…", ".]", "?”", ". 12."]
    texts = [w + t for w in words for t in tails]
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", (F.col("t").rlike(truncation.WORD_STOP) & ~F.col("t").rlike(truncation.SHORT_STOP)).alias("e"))
    ended = [r["t"] for r in d.collect() if r["e"]]
    assert "This ends here." in ended and "see Prof." not in ended and len(ended) > 20
    assert [t for t in ended if truncation.inspect(t)[2] != "sentence"] == []
