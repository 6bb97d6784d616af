import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest

from litloom.llm import canonical, cooccurrence, term_counts

BASKET = "record_id long, items array<string>, n long, item string"


def baskets(n=400, seed=1):
    r = random.Random(seed)
    vocab = [f"i{k}" for k in range(60)]
    out = []
    for i in range(n):
        s = [r.choice(vocab[: r.choice((5, 20, 60))]) for _ in range(r.randint(0, 7))]
        out.append((i, s + s[:1], 7, "clash"))
    return [*out, (n, None, 1, None), (n + 1, [], 1, None), (n + 2, [None, "i1", "i1"], 1, None)]


@pytest.mark.parametrize("share", [2, 256, 10**6])
def test_pairs_equal_plain_counting(spark, share):
    rows = baskets()
    got = cooccurrence.item_pairs(spark.createDataFrame(rows, BASKET), least_together=3, least_lift=1.2, heavy_share=share).collect()
    sets = [{x for x in (r[1] or []) if x is not None} for r in rows]
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    want = {p: c for p, c in two.items() if c >= 3 and c * len(rows) >= 1.2 * one[p[0]] * one[p[1]]}
    assert {(r["item_a"], r["item_b"]): r["n_ab"] for r in got} == want
    for r in got:
        assert r["n_a"] == one[r["item_a"]] and r["n_b"] == one[r["item_b"]] and abs(r["lift"] - r["n_ab"] * len(rows) / (r["n_a"] * r["n_b"])) < 1e-9


def test_a_wide_basket_is_counted_whole(spark):
    wide = [f"w{k}" for k in range(300)]
    d = spark.createDataFrame([(i, wide, 0, "") for i in range(6)] + [(i, ["z"], 0, "") for i in range(6, 60)], BASKET)
    assert cooccurrence.item_pairs(d).count() == 300 * 299 // 2


def test_no_rows_no_pairs(spark):
    assert cooccurrence.item_pairs(spark.createDataFrame([], BASKET)).count() == 0


@pytest.mark.parametrize("limit", [32 << 20, 2000])
def test_terms_equal_plain_counting(spark, limit):
    rows = baskets(1500)
    uses, n = Counter(), Counter()
    for r in rows:
        have = [x for x in (r[1] or []) if x]
        uses.update(have)
        n.update(set(have))
    got = term_counts.term_counts(spark.createDataFrame(rows, BASKET), bytes_in_memory=limit).collect()
    assert {r["term"]: (r["uses"], r["n_rows"]) for r in got} == {t: (uses[t], n[t]) for t in uses}


def test_spilling_splits_again(tmp_path):
    r = term_counts.Radix(str(tmp_path), bytes_in_memory=3000)
    want = Counter()
    for k in range(60):
        terms = [f"term {k % 7} {i}" for i in range(80)]
        want.update(terms)
        r.add(pa.RecordBatch.from_arrays([pa.array(terms), pa.array([1] * 80, pa.int64()), pa.array([1] * 80, pa.int64())], schema=term_counts.SCHEMA))
    assert r.spilled
    got = {}
    for b in r.result():
        for t, u in zip(b["term"].to_pylist(), b["uses"].to_pylist(), strict=True):
            assert t not in got
            got[t] = u
    assert got == dict(want) and not any(tmp_path.iterdir())


def test_bands_and_empty_table(spark):
    d = spark.createDataFrame([("a", 9, 2), ("b", 9, 3), ("c", 99, 11), ("d", 10, 10)], "term string, uses long, n_rows long")
    assert {r["term"]: r["band"] for r in term_counts.band_terms(d, 100).collect()} == {"a": "rare", "b": "useful", "c": "common", "d": "useful"}
    assert term_counts.term_counts(spark.createDataFrame([], BASKET)).count() == 0


INST = [(1, "University of Zovudute"), (2, "Zurasanu University of Technology"), (3, "Zurasanu State University"), (4, "Hefisife Polytechnic")]
KEYS = [(11, "plagiarism detection"), (12, "artificial intelligence"), (13, "large language models"), (14, "false positive rate"), (15, "text reuse")]


def test_institutions():
    m = canonical.institution_matcher(INST)
    cases = {
        "Dept of X, University of Zovudute, Town, Land": 1, "Univ Zovudute, Land": 1, "Zurasanu UT, Town": 2, "School of Law, ZURASANU SU": 3, "Zurasanu Univ. Technol.": 2,
        "Univeristy of Zovudtue": 1, "Hefisife Polytehcnic, Y": 4, "Universität Zovudute": 1, "The Hefisife Polytech": 4, "Zurasanu Polytechnic": -1, "Fikomo Secondary School": -1,
        "[Zurasanu, Technol; Univ, Of] Other Place": -1, "": -1, "Zurasanu University fo Technology": 2,
    }
    assert {v: m.match(v)[0] for v in cases} == cases


def test_keywords():
    m = canonical.keyword_matcher(KEYS, [("AI", "Artificial Intelligence"), ("LLM", "large language models"), ("XX", "off the list")])
    cases = {"detection of plagiarism": 11, "A.I.": 12, "LLMs": 13, "Large-Language  Model": 13, "FPR": 14, "Text Reesue": 15, "plagiarism detections (general)": 11, "tram timetable": -1, "n/a": -1, "artifical_intelligence*": 12, "detection": -1}
    assert {v: m.match(v)[0] for v in cases} == cases


def test_mapping_keeps_rows_and_handles_nulls(spark):
    d = spark.createDataFrame([(1, "AI", "x"), (1, "AI", "x"), (2, None, None), (3, "", "y")], "row long, val string, score string")
    got = canonical.map_values(d, KEYS, canonical.keyword_matcher, aliases=[("AI", "artificial intelligence")])
    assert got.columns == ["row", "val", "ref_id", "how", "score"] and sorted(r["ref_id"] for r in got.collect()) == [-1, -1, 12, 12]
    assert {r["ref_id"] for r in canonical.map_values(d, [], canonical.keyword_matcher).collect()} == {-1}
    assert canonical.map_values(d.limit(0), KEYS, canonical.keyword_matcher).count() == 0


def test_mentions_do_not_overlap():
    m = canonical.institution_matcher([(7, "Alpha University"), (3, "Gamma University"), (9, "Gamma University Hospital Trust"), (5, "Trust Delta")])
    t = lambda v: m.mentions(m.tokenise(v))
    assert t("Alpha / Gamma University, Alpha University") == [3, 7] == t("Alpha University and Gamma University")  # equally long: smallest id first
    assert t("Gamma University Hospital Trust Delta") == [9]  # Trust Delta overlaps it
    assert m.match("Alpha Univ; Gamma Univ")[0] == 3


def test_edits():
    assert canonical.edits("abcd", "abdc", 2) == 1 and canonical.edits("abc", "abc", 2) == 0 and canonical.edits("abc", "xyz", 2) == 3
