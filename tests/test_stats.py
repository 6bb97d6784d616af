import json
import math
import random

import numpy as np
import pytest

from litloom.operators import agreement, countreg, coverage, similarity, stats, temporal, topics
from litloom.plans import catalog
from litloom.sources import readers, writers

L = ["x", "y", "z"]


def kappa(a, b):
    n = len(a)
    ok = [(p, q) for p, q in zip(a, b, strict=True) if p in L and q in L]
    po = sum(p == q for p, q in ok) / n
    pe = sum(sum(p == v for p, _ in ok) * sum(q == v for _, q in ok) for v in L) / n**2
    return (po - pe) / (1 - pe)


def test_kappa_cases(spark):
    r = random.Random(1)
    a, b = [r.choice([*L, "off"]) for _ in range(60)], [r.choice(L) for _ in range(60)]
    row = agreement.kappa(spark.createDataFrame(list(zip(a, b)), "a string, b string"), L).first()
    assert row["n"] == 60 and abs(row["kappa"] - kappa(a, b)) < 1e-9
    one = lambda rows: agreement.kappa(spark.createDataFrame(rows, "a string, b string"), L).first()
    assert one([("x", "x"), ("y", "y")])["kappa"] == 1.0 and one([("x", "x")])["kappa"] is None and one([])["kappa"] is None


def test_growth_is_positional(spark):
    rows = [(2020, "a"), (2022, "a"), (2023, "a"), (2022, "b"), (2020, "b"), (2023, "n"), (2023, "n"), (2020, "once")]
    g = {r["item"]: r for r in temporal.burst_classes(temporal.growth(spark.createDataFrame(rows, "y int, i string"), "y", "i")).collect()}
    assert g["a"]["early"] == 2 and g["a"]["late"] == 1 and g["b"]["class"] == "declining" and g["n"]["growth_rate"] == 999 and g["n"]["class"] == "emerging" and "once" not in g


def test_overlap_with_empty_keys(spark):
    d = lambda rows: spark.createDataFrame(rows, "doi string, title string")
    core, ext = coverage.key_sets(d([("10.1/a", "Alpha")])), coverage.key_sets(d([("10.1/a", "Alpha"), (None, "Beta!")]))
    r = coverage.overlap(d([("DOI:10.1/A", "zzz"), (None, "beta"), ("10.9/q", None), (None, None), ("", "")]), core, ext).first()
    assert (r["n"], r["in_core"], r["in_extended"]) == (5, 1, 2)
    assert coverage.overlap(d([]), core, ext).first()["core_share"] is None


def test_cosine_moments(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(40, 5))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(98, None), (99, [0.0] * 5)]
    u = m / np.linalg.norm(m, axis=1)[:, None]
    c = (u @ u.T)[np.triu_indices(40, 1)]
    got = similarity.pair_moments(spark.createDataFrame(rows, "k long, v array<double>"), "v").first()
    assert got["n_pairs"] == 780 and abs(got["mean"] - c.mean()) < 1e-9 and abs(got["deviation"] - c.std()) < 1e-9
    assert similarity.pair_moments(spark.createDataFrame([], "v array<double>"), "v").first()["mean"] is None


def test_count_model_recovers_coefficients(spark):
    rng = np.random.default_rng(4)
    n = 4000
    x, e = rng.normal(size=n), rng.uniform(0.5, 4, n)
    mu = np.exp(0.4 + 0.6 * x + np.log(e))
    y = rng.negative_binomial(1 / 0.8, 1 / (1 + 0.8 * mu))
    d = spark.createDataFrame([(int(a), float(b), float(math.log(c)), f"v{i % 40}") for i, (a, b, c) in enumerate(zip(y, x, e))], "y long, x double, le double, venue string").cache()
    f = countreg.fit_nb(d, "y", ["x"], offset="le", cluster="venue")
    assert abs(f.theta[0] - 0.4) < 0.1 and abs(f.theta[1] - 0.6) < 0.1 and abs(f.alpha - 0.8) < 0.15 and f.clusters == 40
    z = spark.createDataFrame([(0 if i % 3 == 0 else int(a), float(b)) for i, (a, b) in enumerate(zip(rng.negative_binomial(2, 0.2, n), x))], "y long, x double").cache()
    g = countreg.fit_nb(z, "y", ["x"], inflated=True)
    assert abs(1 / (1 + math.exp(-g.theta[-1])) - 0.33) < 0.06 and g.aic > 0
    assert {r["term"] for r in g.table(spark).collect()} == {"Intercept", "x", "alpha", "inflate_const"}


def test_score_matches_differences():
    rng = np.random.default_rng(2)
    x, y, off = np.column_stack([np.ones(30), rng.normal(size=30)]), rng.poisson(2, 30).astype(float), np.zeros(30)
    for inflated in (False, True):
        t = np.array([0.3, 0.2, -0.4] + ([-1.0] if inflated else []))
        s = countreg.loglik(t, x, y, off, inflated)[1].sum(0)
        for j in range(len(t)):
            h = np.zeros(len(t))
            h[j] = 1e-6
            d = (countreg.loglik(t + h, x, y, off, inflated)[0].sum() - countreg.loglik(t - h, x, y, off, inflated)[0].sum()) / 2e-6
            assert abs(d - s[j]) < 1e-3


def test_topics_contract(spark):
    rows = [(i, ["alpha beta gamma", "delta epsilon zeta", "theta iota kappa"][i % 3] + " common words here") for i in range(90)]
    lists = topics.token_lists(spark.createDataFrame(rows, "id long, t string"), "id", "t", two=True)
    got = topics.clusters(topics.vectors(lists, "id"), "id", k=3, outliers=0.05)
    assert got.count() == 90 and got.filter("topic >= 0").select("topic").distinct().count() == 3
    w = topics.topic_words(lists, got, "id", 3).first()
    assert len(w["words"]) == 3 and w["label"].startswith("T")
    assert topics.coherence(lists, [["alpha", "beta"], ["delta", "zeta"]]) > topics.coherence(lists, [["alpha", "delta"], ["beta", "zeta"]])


def test_topics_cover_every_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r[0] for r in topics.token_lists(docs, "doc_id", "text").select("doc_id").collect()}
    got = [r["doc_id"] for r in catalog.QUERIES["document_topics"](spark, sf).collect()]
    assert len(got) == len(want) and set(got) == want


def test_lda_sweeps_all_sizes(spark, sf):
    got = {r["k"]: r for r in catalog.QUERIES["lda_coherence"](spark, sf).collect()}
    assert sorted(got) == list(range(3, 16))
    best = [r for r in got.values() if r["best"]]
    assert len(best) == 1 and best[0]["coherence"] == max(r["coherence"] for r in got.values())
    assert len(best[0]["topics"]) == best[0]["k"] and all(r["topics"] is None for r in got.values() if not r["best"])


def test_lda_finds_planted_topics_and_passes_serve_all_models(spark):
    rng = np.random.default_rng(4)
    own = [[f"{t}word{j}" for j in range(12)] for t in "abcd"]
    rows = [(i, [str(w) for w in rng.choice(own[i % 4], 20)] + ["only" if i else "once"]) for i in range(200)]
    lists = spark.createDataFrame(rows, "id long, words array<string>").cache()
    sc = spark.sparkContext
    sc.setJobGroup("lda", "")
    scores, words = topics.lda_sweep(lists, range(3, 9), max_df=0.5)
    jobs = len(sc.statusTracker().getJobIdsForGroup("lda"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    got = {r["k"]: r["coherence"] for r in scores.collect()}
    assert sorted(got) == [3, 4, 5, 6, 7, 8] and jobs < 80  # a pass of its own for each model took 150 and more
    fitted = topics._lda(topics._bags(lists, [w for o in own for w in o]), 48, [4], 20, 42)[4]
    assert all(len({int(i) // 12 for i in np.argsort(-t)[:3]}) == 1 for t in fitted)
    assert words.count() == max(got, key=lambda k: (got[k], -k))


def test_window_counts_by_hand(spark):
    rows = [(0, "a b c d a e".split()), (1, ["a", "e"]), (2, ["x"])]
    total, both = topics.window_counts(spark.createDataFrame(rows, "id long, words array<string>"), ["a", "b", "e"], 3)
    windows = [w for _, t in rows for w in ({*t[s : s + 3]} for s in range(max(len(t) - 2, 1)))]
    assert total == len(windows) == 6
    assert all(both[i, j] == sum(x in w and y in w for w in windows) for i, x in enumerate("abe") for j, y in enumerate("abe"))


def test_median_split_and_ranks(spark):
    d = spark.createDataFrame([(i, float(i), float(-i)) for i in range(4)], "k int, a double, b double")
    q = {r["k"]: r["quadrant"] for r in stats.median_split(d, "a", "b").collect()}
    assert q == {0: "niche", 1: "niche", 2: "basic/transversal", 3: "basic/transversal"}


def test_tagged_files(spark, tmp_path):
    content = "﻿FN Test\nVR 1.0\nPT J\nAU Su, Z\n   Lee, K\nTI A title\n   goes on\nPY 2020\nTC 4\nC1 [Su, Z] Univ A, China.\n   [Lee, K] Univ B, USA.\nCR Smith J, 2010, J A\n   Roe K, 2011\nER\n\nPT J\nAU Only, A\nER\nPT J\nTI No end\nZ9 2"
    (tmp_path / "a.txt").write_text(content, encoding="utf-8")
    (tmp_path / "b.txt").write_text("PT J\nTI Other\nER\nEF\nPT J\nTI After the end\nER\n", encoding="utf-8")
    rows = readers.tagged_rows(readers.read_tagged(spark, f"{tmp_path}/*.txt")).orderBy("file", "row_no").collect()
    assert [r["title"] for r in rows] == ["A title goes on", "No end", "Other"]
    a = rows[0]
    assert a["author_full_names"] == "Su, Z; Lee, K" and a["affiliations"] == "Univ A, China.; Univ B, USA." and a["cr_list"] == ["Smith J, 2010, J A", "Roe K, 2011"]
    assert a["cited_by"] == "4" and rows[1]["cited_by"] == "2" and rows[2]["abstract"] == "[No abstract available]"
    spark.dataSource.register(readers.TaggedSource)
    assert spark.read.format("tagged").option("path", f"{tmp_path}/a.txt").load().count() == 3


def test_csv_json_bibtex(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Title,Year,Cited by\n"A, ""quoted""\ntitle",2020,\nB,garbage,5\n')
    d = readers.read_tabular(spark, f"{tmp_path}/x.csv")
    assert d.columns == readers.CANONICAL and d.filter("title like '%quoted%'").count() == 1 and d.first()["source_db"] == "Scopus"
    with pytest.raises(ValueError):
        readers.read_tabular(spark, f"{tmp_path}/x.csv", ["orig_language"])
    for n, v in (("c_1.json", "technical"), ("c_2.json", "governance")):
        (tmp_path / n).write_text(json.dumps([{"paper_id": "P001", "orientation": v}]))
    assert readers.read_codings(spark, f"{tmp_path}/c_*.json").first()["orientation"] == "governance"
    (tmp_path / "s.bib").write_text("Header\n@ARTICLE{key1,\n author = {A and B},\n title = {T {x}},\n year = {2020}\n}\n\n@BOOK{key2,\n title = {U}\n}\n")
    b = {r["cite_key"]: r for r in readers.read_bibtex(spark, f"{tmp_path}/s.bib").collect()}
    assert b["key1"]["fields"]["year"] == "2020" and b["key1"]["kind"] == "ARTICLE" and b["key2"]["fields"]["title"] == "U"


def test_pages_and_retries(spark, tmp_path):
    pages = [{"meta": {"count": 3, "next_cursor": "b"}, "results": [{"id": "1", "primary_location": {"source": {"display_name": "V"}}}, {"id": "2"}]}, {"meta": {"count": 3, "next_cursor": None}, "results": [{"id": "3"}]}]
    calls = []

    def get(url):
        calls.append(url)
        return json.dumps(pages[len(calls) - 1]).encode()

    got = list(readers.works_pages("http://x", "a:b|c", 10, 2, get))
    assert len(got) == 2 and "filter=a:b|c" in calls[0]
    calls.clear()
    assert len(list(readers.works_pages("http://x", "a", 2, 2, get))) == 1  # the cap is checked per page
    for i, p in enumerate(pages):
        (tmp_path / f"p{i}.json").write_text(json.dumps(p))
    w = readers.works(spark, f"{tmp_path}/p*.json").orderBy("id").collect()
    assert [r["id"] for r in w] == ["1", "2", "3"] and w[0]["venue"] == "V"
    waits = []

    def broken(url, timeout):
        raise OSError("no network")

    with pytest.raises(OSError):
        readers.fetch("http://x", opener=broken, wait=waits.append, retries=3, backoff=8)
    assert waits == [8, 16]
    rows = {r["name"]: r for r in readers.probed(spark, {"good": lambda: 1, "bad": lambda: 1 / 0}).collect()}
    assert rows["good"]["value"] == 1.0 and "ZeroDivision" in rows["bad"]["error"]


def test_read_through_and_writers(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.createDataFrame([(1, "a")], "id int, x string")

    for _ in range(2):
        assert readers.read_through(spark, f"{tmp_path}/cache", build).count() == 1
    readers.read_through(spark, f"{tmp_path}/cache", build, force=True)
    assert len(built) == 2
    v, e = spark.createDataFrame([("a&b", "L<1"), ("c", None)], "id string, label string"), spark.createDataFrame([("a&b", "c", 2)], "src string, dst string, weight int")
    writers.write_graphml(f"{tmp_path}/g.graphml", v, e)
    import xml.dom.minidom

    x = xml.dom.minidom.parse(f"{tmp_path}/g.graphml")
    assert len(x.getElementsByTagName("node")) == 2 and x.getElementsByTagName("edge")[0].getAttribute("source") == "a&b"
    writers.write_document(f"{tmp_path}/d.json", {"v": v})
    assert json.load(open(f"{tmp_path}/d.json"))["v"][0]["id"] == "a&b"
    writers.write_csv(v, f"{tmp_path}/csv", ["id", "absent"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["id"]


def test_percentiles_are_exact_per_group(spark):
    rows = [("a", float(v)) for v in (5, 1, 1, 9)] + [("b", 3.0), ("b", None), (None, 4.0), (None, 8.0), ("c", None)]
    d = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["n"], r["median"]) for r in stats.group_summary(d, "g", "v").collect()}
    assert got == {"a": (4, 3.0), "b": (2, 3.0), None: (2, 6.0), "c": (1, None)}
    s = stats.summary(d, "v").first()
    assert (s["n"], s["q25"], s["median"], s["q75"]) == (7, 2.0, 4.0, 6.5)
    e = stats.summary(d.limit(0), "v").first()
    assert e["n"] == 0 and e["median"] is None


def test_pairs_of_large_containers_in_tiles(spark):
    from collections import Counter
    from itertools import combinations

    from litloom.operators import pairs

    rows = [("hot", f"i{k:03d}") for k in range(90)] + [(f"c{k % 7}", f"i{k:03d}") for k in range(60)] + [("hot", "i001"), (None, "i1"), ("c1", None)]
    d = spark.createDataFrame(rows, "c string, i string")
    want = Counter()
    for c in {r[0] for r in rows if r[0]}:
        want.update(combinations(sorted({i for x, i in rows if x == c and i}), 2))
    for least in (1, 2):
        for tile in (8, 2048):
            assert {(r["src"], r["dst"]): r["weight"] for r in pairs.pair_counts(d, "c", "i", least, tile).collect()} == {p: n for p, n in want.items() if n >= least}
