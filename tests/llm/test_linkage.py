import random

import numpy as np

from litloom.llm import linkage


def wos(spark, lines):
    return linkage.wos_attributes(spark.createDataFrame(list(enumerate(lines, 1)), "k long, t string"), "k", "t")


def scopus(spark, lines):
    return linkage.scopus_attributes(spark.createDataFrame(list(enumerate(lines, 1001)), "k long, t string"), "k", "t")


def test_parsers(spark):
    w = wos(spark, ["Sohavik SK, 2005, INT J WRIT ASSESS, V70, P12, DOI [10.1/a, 10.1/A]", "delSin G, 2014, P ZIR S, P5", None, "", "X"]).orderBy("id").collect()
    assert (w[0]["surname"], w[0]["initials"], w[0]["year"], w[0]["volume"], w[0]["page"], w[0]["j"]) == ("sohavik", "sk", 2005, 70, 12, "INT J WRIT ASSESS")
    assert w[1]["surname"] == "delsin" and w[1]["volume"] is None and w[2]["surname"] is None and w[4]["year"] is None
    s = scopus(spark, ["Közuta K.B.; Lee J., A title, with commas, International Journal of Writing Assessment, 70, pp. 12-19, (2005)", "de Sin G., T, Proc X, p. 5, 2014", "Abc D., T, J, 3, pp. 1-2, in press"]).orderBy("id").collect()
    assert (s[0]["surname"], s[0]["initials"], s[0]["year"], s[0]["volume"], s[0]["page"]) == ("kozuta", "kb", 2005, 70, 12)
    assert s[1]["page"] == 5 and s[1]["year"] == 2014 and s[1]["volume"] is None and s[2]["year"] is None and s[2]["volume"] == 3
    assert s[0]["j"] == "International Journal of Writing Assessment"


def works(n, seed=3):
    r = random.Random(seed)
    names = ["".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(4)) for _ in range(max(8, n // 3))]
    full = [("Journal of Writing Assessment", "J WRIT ASSESS"), ("Annals of Forensic Linguistics", "ANN FORENSIC LINGUIST"), ("Information Policy Letters", "INFORM POLICY LETT")]
    return [(r.choice(names).capitalize(), r.choice("ABCDEFG"), r.randint(1998, 2024), *r.choice(full), r.randint(1, 90), r.randint(1, 1800)) for _ in range(n)]


def test_links_noisy_entries_and_repeats(spark):
    r = random.Random(9)
    ws, ss = [], []
    ids = works(240)
    for i, (a, f, y, full, short, v, p) in enumerate(ids):
        slip = a[:2] + a[3] + a[2] + a[4:] if r.random() < 0.15 else a
        ws.append(f"{slip} {f}, {y}, {short}" + (f", V{v}" if r.random() > 0.1 else "") + f", P{p}")
        if i < 160:
            ss.append(f"{a} {f}., A title of {i}, {full}, {v}, pp. {p}-{p + 9}, " + (f"({y})" if r.random() > 0.1 else "in press"))
    ws.append(ws[0])  # the same entry twice
    got = {(x["id_a"], x["id_b"]) for x in linkage.link(wos(spark, ws), scopus(spark, ss)).collect()}
    assert {(x["id_a"], x["id_b"]) for x in linkage.link(wos(spark, ws), scopus(spark, ss), most_pairs=0).collect()} == got  # every block finer
    want = {(i + 1, i + 1001) for i in range(160)} | {(241, 1001)}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    assert ((1, 1001) in got) == ((241, 1001) in got)


def test_large_blocks_keep_slipped_pages(spark):
    ids = works(120, seed=5)
    ws = [f"{a} {f}, {y}, {short}, V{v}, P{p}" for a, f, y, _, short, v, p in ids]
    ss = [f"{a} {f}., A title of {i}, {full}, {v}, pp. {p + (i % 4 == 0)}-{p + 9}, ({y})" for i, (a, f, y, full, _, v, p) in enumerate(ids)]
    whole = {tuple(x) for x in linkage.link(wos(spark, ws), scopus(spark, ss), least=0.0).select("id_a", "id_b").collect()}
    tiled = {tuple(x) for x in linkage.link(wos(spark, ws), scopus(spark, ss), least=0.0, most_pairs=0).select("id_a", "id_b").collect()}
    assert tiled == whole and sum((i + 1, i + 1001) in whole for i in range(0, 120, 4)) > 20


def test_em_on_patterns():
    rng = np.random.default_rng(0)
    match = np.where(rng.random((600, 6)) < 0.9, 3, 1)
    other = np.where(rng.random((1400, 6)) < 0.6, 3, 0)
    other[:, 5] = np.where(rng.random(1400) < 0.04, 3, 0)
    p, n = np.unique(np.vstack([match, other]), axis=0, return_counts=True)
    fitted = linkage.fit(p, n.astype(float))
    assert (linkage.posterior(match, *fitted) > 0.5).mean() > 0.97 and (linkage.posterior(other, *fitted) > 0.5).mean() < 0.03


def test_empty_lists_and_entries_without_attributes(spark):
    assert linkage.link(wos(spark, []), scopus(spark, [])).count() == 0
    assert linkage.link(wos(spark, ["", None, "?"]), scopus(spark, ["", None])).count() == 0
