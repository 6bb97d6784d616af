import datetime as dt

from litloom.llm import survivors
from litloom.llm.components import components

PAPER = "record_id long, source_db string, wos_ut string, doi string, title string, abstract string, cited_by string, author_full_names string, source_title string, pub_year string, exported_at timestamp, group_id string, v string"
T = dt.datetime(2024, 1, 1)
TITLE = "Rethinking token watermarks after peer review: a study of trust in law schools"
ABSTRACT = "We asked many people about many things. They answered in full sentences, and we wrote it all down here. Nothing was lost."


def row(i, db="Scopus", ut=None, doi=None, title=TITLE, abstract=ABSTRACT, cites=None, author="Lee, Kim (5)", journal="J Tests", year="2023", day=0):
    return (i, db, ut, doi, title, abstract, cites, author, journal, year, T + dt.timedelta(days=day), "clash", "clash")


def groups(spark, rows):
    return dict(survivors.duplicate_groups(spark.createDataFrame(rows, PAPER)).collect())


def test_groups_by_keys_slips_and_cuts(spark):
    g = groups(spark, [
        row(5, doi="10.98765/a.00.000001"), row(3, "WoS", doi="DOI 10.98765/A.00.000001", title=TITLE.upper()),
        row(9, title=TITLE.replace("token", "tokne") + "."), row(8, title=TITLE[:45] + "…"), row(7, "WoS", "U1", title=None), row(2, "WoS", "U1", title=TITLE),
        row(11, title=TITLE + ", revisited", year="2020", abstract="Other text altogether, with its own words."), row(12, title=TITLE + " (Part II)", year="2019", abstract=None),
        row(13, title="Correction to: " + TITLE, abstract=None), row(14, author="Other, Name", journal="Elsewhere", abstract=None), row(15, title=None, author=None), row(16, title=None, author=None),
    ])
    assert {g[i] for i in (2, 3, 5, 7, 8, 9)} == {2}
    assert all(g[i] == i for i in (11, 12, 13, 14, 15, 16))


def test_large_blocks_lose_nothing(spark):
    rows = many(30) + [row(5000 + i, title=f"Study number {i} of watermarks: results from the Zan{i}ka regio.", abstract=None) for i in range(30)] + [row(6000 + i, title=f"Study number {i} of watermarks: resul…") for i in range(30)]
    d = spark.createDataFrame(rows, PAPER)
    assert dict(survivors.duplicate_groups(d, most_pairs=0).collect()) == dict(survivors.duplicate_groups(d).collect())


def test_no_key_of_like_titles_forms_all_pairs(spark):
    from pyspark.sql import functions as F

    head, tail = "On the reception of generated essays in", "the law schools of the north"
    rows = [(i, f"{head} {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)} district {tail}", False, "lee", "jtests", None if i % 3 else f"text {i}", str(2000 + i % 20), i % 2 == 0) for i in range(4000)]
    d = spark.createDataFrame([(*r[:1], "".join(x for x in r[1].lower() if x.isalnum()), *r[2:]) for r in rows], "label long, t string, cut_title boolean, author string, journal string, begin string, year string, has_doi boolean")
    keyed = survivors.blocked(d, 100_000)
    most = keyed.groupBy("key").agg((F.count_if("is_q") * F.count_if("is_o")).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 150_000  # tiles of 316 x 316 by hash
    assert survivors.blocked(d, 10_000_000).groupBy("key").agg((F.count_if("is_q") * F.count_if("is_o")).alias("n")).agg(F.max("n")).first()[0] == 2000 * 4000


def test_rows_without_author_or_long_title(spark):
    g = groups(spark, [row(1, author=None), row(2, author=None), row(3, author=None, year="2019"), row(4, title="Editorial"), row(5, title="EDITORIAL."), row(6, title="Editorial", year="2019"), row(7, title="Editorial", abstract=None), row(8, title="Editorial", abstract=None)])
    assert g[2] == 1 and g[5] == 4 and g[6] == 6 and g[7] == 7 and g[8] == 8


def test_rare_doi_forms_join_unless_cut(spark):
    rows = [row(i, doi=f"10.98765/a.00.{i:06d}", title=f"An altogether different title number {i} here") for i in range(1, 60)]
    rows += [row(100, doi="10.5/zz", title="Alpha and its uses in the courts", author="A"), row(101, doi="10.5555/zz-1", title="Beta beta beta beta beta beta", author="B"), row(102, doi="10.5555/ZZ-1", title="Gamma gamma gamma gamma gamma", author="C")]
    rows += [row(200, doi="10.98765/a.00.00", title="Delta delta delta delta delta", author="D"), row(201, doi="10.98765/a.00.00", title="Omega omega omega omega omega", author="E")]
    g = groups(spark, rows)
    assert g[102] == 101 and g[200] == 200 and g[201] == 201


def test_different_dois_stay_apart(spark):
    g = groups(spark, [row(1, doi="10.98765/a.00.000001", title=TITLE), row(2, doi="10.98765/a.00.000002", title=TITLE.replace("law", "lww"))])
    assert g == {1: 1, 2: 2}


def many(n=60):
    """Groups of three rows: two unaltered, one altered in one of several ways; then groups that hold altered forms only."""
    out = []
    for k in range(n):
        doi, title = f"10.98765/a.00.{k:06d}", f"Study number {k} of watermarks: results from the Zan{k}ka region"
        text = f"Text {k} begins here and goes on. It has a second sentence which is longer. And a third one ends it."
        bad = [("DOI " + doi.upper(), title.upper(), text[:40] + "…"), ("https://doi.org/" + doi, title + ".", text[:60]), (doi.replace("/", " / "), title.lower(), "[No abstract available]")][k % 3]
        base = 10 * k + 1
        out += [row(base, doi=bad[0], title=bad[1], abstract=bad[2], cites="5", day=2, ut=f"U{k}"), row(base + 1, doi=doi, title=title, abstract=text, cites=" 12", day=9, ut=f"U{k}"), row(base + 2, "WoS", doi=doi, title=title, abstract=text, cites="n/a", day=11, ut=f"U{k}")]
    return out


def test_unaltered_values_survive(spark):
    rows = many() + [row(9001, doi="10.98765/A.00.777777", title="A LONE TITLE ABOUT MANY THINGS", abstract=None, ut="V"), row(9002, doi=None, title="A LONE TITLE ABOUT MANY THINGS", abstract="", ut="V")]
    d = spark.createDataFrame(rows, PAPER)
    found = survivors.survivors(d)
    got = {(r["group_id"], r["field_name"]): r["record_id"] for r in found.collect()}
    for k in range(60):
        g = 10 * k + 1
        assert got[g, "doi"] == got[g, "title"] == got[g, "abstract"] == g + 1
        assert got[g, "cited_by"] == g + 1  # the latest readable count
    assert not [key for key in got if key[0] == 9001]  # only altered forms: nothing survives
    m = {r["group_id"]: r for r in survivors.merged_records(d, found).collect()}
    assert m[1]["cited_by"] == 12 and m[1]["doi"] == "10.98765/a.00.000000"


def test_counts_compare_as_numbers(spark):
    d = spark.createDataFrame([row(1, cites="8.0", ut="U"), row(2, cites="8", ut="U", day=5), row(3, cites="1,234", ut="W"), row(4, cites="-", ut="W", day=9)], PAPER)
    g = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "record_id long, group_id long")
    assert {(r["group_id"], r["record_id"]) for r in survivors.latest_count(d, g).collect()} == {(1, 1), (3, 3)}


def test_several_values_may_survive(spark):
    g = spark.createDataFrame([(i, 10 * ((i - 1) // 10) + 1) for k in range(60) for i in (10 * k + 1, 10 * k + 2, 10 * k + 3)], "record_id long, group_id long")
    d = spark.createDataFrame(many(), PAPER)
    one, all_ = survivors.surviving_values(d, g, "title").count(), survivors.surviving_values(d, g, "title", multi=True).count()
    assert one == 60 and all_ >= one


def test_empty_table(spark):
    e = spark.createDataFrame([], PAPER)
    assert survivors.duplicate_groups(e).count() == 0 and survivors.survivors(e).count() == 0


def test_components_of_chains_and_hubs(spark):
    links = [(i, f"c{i}") for i in range(1, 80)] + [(i + 1, f"c{i}") for i in range(1, 80)] + [(i, "hub") for i in range(200, 400)] + [(999, "own")]
    got = dict(components(spark.createDataFrame([(i,) for i in [*range(1, 81), *range(200, 400), 999]], "id long"), spark.createDataFrame(links, "id long, key string")).collect())
    assert {got[i] for i in range(1, 81)} == {1} and {got[i] for i in range(200, 400)} == {200} and got[999] == 999


def test_real_counts_break_ties(spark):
    values = ["A study of things and words"] * 52 + ["A study of things and longer words"] * 48
    rows = spark.createDataFrame([(i, "one", v) for i, v in enumerate(values)], "record_id long, source_db string, title string")
    groups = rows.selectExpr("record_id", "0L as group_id")
    assert [r["record_id"] for r in survivors.surviving_values(rows, groups, "title", least=0.0).collect()] == [0]
