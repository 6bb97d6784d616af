import itertools
import random
from collections import defaultdict

from litloom.operators import graph, pairs


def random_graph(n=24, p=0.18, seed=3):
    r = random.Random(seed)
    return [(a, b, r.randint(1, 4)) for a, b in itertools.combinations(range(n), 2) if r.random() < p]


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long, weight long")


def neighbours(edges):
    n = defaultdict(set)
    for a, b, *_ in edges:
        if a != b:
            n[a].add(b)
            n[b].add(a)
    return n


def test_clustering_and_components(spark):
    e = [*random_graph(), (90, 91, 1), (92, 92, 1)]
    n = neighbours(e)
    got = {r["id"]: r["coefficient"] for r in graph.clustering(frame(spark, e)).collect()}
    for v, k in n.items():
        t = sum(b in n[a] for a, b in itertools.combinations(k, 2))
        assert abs(got[v] - (2 * t / (len(k) * (len(k) - 1)) if len(k) > 1 else 0)) < 1e-9
    comp = {r["id"]: r["component"] for r in graph.components(frame(spark, e)).collect()}
    seen = {}
    for v in sorted({x for a, b, _ in e for x in (a, b)}):
        if v not in seen:
            todo = [v]
            while todo:
                u = todo.pop()
                if u not in seen:
                    seen[u] = v
                    todo += n[u]
    assert comp == seen


def test_long_chain_settles(spark):
    e = frame(spark, [(i, i + 1, 1) for i in range(300)])
    assert graph.components(e).select("component").distinct().count() == 1


def paths(n, s, t):
    """All shortest paths by breadth, unweighted."""
    best, todo = [], [[s]]
    while todo and not best:
        new = []
        for p in todo:
            for u in n[p[-1]]:
                if u == t:
                    best.append([*p, u])
                elif u not in p:
                    new.append([*p, u])
        todo = new
    return best


def test_betweenness(spark):
    e = random_graph(9, 0.3, 5)
    n = neighbours(e)
    want = defaultdict(float)
    for s, t in itertools.combinations(sorted(n), 2):
        ps = paths(n, s, t)
        for p in ps:
            for v in p[1:-1]:
                want[v] += 1 / len(ps)
    k = len(n)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(frame(spark, e)).collect()}
    for v in n:
        assert abs(got[v] - want[v] * 2 / ((k - 1) * (k - 2))) < 1e-9


def test_eigenvector_of_a_star(spark):
    got = {r["id"]: r["centrality"] for r in graph.eigenvector(frame(spark, [(0, i, 1) for i in range(1, 5)])).collect()}
    assert abs(got[0] - 2**-0.5) < 1e-3 and abs(got[1] - 8**-0.5) < 1e-3


def test_eigenvector_that_settles_slowly(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 0.85)], "src long, dst long, weight double").coalesce(1)
    got = {r["id"]: r["centrality"] for r in graph.eigenvector(e).collect()}  # more than 100 steps
    assert abs(got[0] - 2**-0.5) < 1e-3 and abs(got[2]) < 1e-3


def planted(groups=4, size=8, seed=1):
    r = random.Random(seed)
    ids = range(groups * size)
    return [(a, b, 1) for a, b in itertools.combinations(ids, 2) if r.random() < (0.8 if a // size == b // size else 0.03)]


def test_louvain_finds_planted_groups(spark):
    e = frame(spark, planted())
    for most in (500_000, 10):  # on the driver, and by distributed moves first
        got = graph.louvain(e, most_local=most)
        by = defaultdict(set)
        for r in got.collect():
            by[r["community"]].add(r["id"] // 8)
        q = graph.modularity(e, got).first()[0]
        assert q > 0.5 and (most == 10 or (len(by) == 4 and all(len(v) == 1 for v in by.values())))


def test_louvain_keeps_its_partition_when_moves_stall(spark, monkeypatch):
    steps = iter(["id div 8", "id"])  # one pass that finds the groups, one that merges nothing
    monkeypatch.setattr(graph, "_moves", lambda e, *_: graph.degrees(e).selectExpr("id", f"{next(steps)} as c"))
    got = graph.louvain(frame(spark, planted()), most_local=3).collect()
    assert len(got) == 32 and len({(r["id"] // 8, r["community"]) for r in got}) == len({r["community"] for r in got}) == 4


def test_modularity_bounds(spark):
    e = frame(spark, planted())
    one = graph.degrees(e).selectExpr("id", "0 as community")
    assert abs(graph.modularity(e, one).first()[0]) < 1e-9


def test_pairs_against_plain_counting(spark):
    r = random.Random(2)
    rows = [(c, r.choice("abcdefg")) for c in range(30) for _ in range(r.randint(0, 5))] + [(None, "a"), (1, None)]
    got = {(x["src"], x["dst"]): x["weight"] for x in pairs.pair_counts(spark.createDataFrame(rows, "c long, i string"), "c", "i", 2).collect()}
    sets = defaultdict(set)
    for c, i in rows:
        if c is not None and i is not None:
            sets[c].add(i)
    want = defaultdict(int)
    for s in sets.values():
        for p in itertools.combinations(sorted(s), 2):
            want[p] += 1
    assert got == {k: v for k, v in want.items() if v >= 2}


def test_callon_with_empty_sides(spark):
    e = spark.createDataFrame([("a", "b", 2), ("c", "d", 1), ("x", "y", 1)], "src string, dst string, weight long")
    m = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 2), ("x", 3), ("y", 3)], "id string, community int")
    n = spark.createDataFrame([(v, 2) for v in "abcdxy"], "id string, n long")
    got = {r["community"]: r for r in graph.callon(e, m, n).collect()}
    assert got[0]["density"] == 100.0 and got[0]["centrality"] == 0.0 and got[1]["density"] == 0.0 and got[1]["centrality"] == 2.5


def test_small_graphs(spark):
    e, v = spark.createDataFrame([], "src long, dst long, weight long"), spark.createDataFrame([(1,)], "id long")
    assert graph.size_and_density(e, v).first()["density"] == 0.0 and graph.average_clustering(e, v).first()[0] == 0.0
    assert graph.components(e, v).first()["component"] == 1 and graph.louvain(e).count() == 0 and graph.eigenvector(e).count() == 0


def test_types_keep_inner_edges(spark):
    v = spark.createDataFrame([("a", "gap"), ("b", "gap"), ("c", "topic")], "id string, type string")
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 1)], "src string, dst string, weight long")
    keep, inner = graph.of_types(v, e, "gap")
    assert keep.count() == 2 and [(r["src"], r["dst"]) for r in inner.collect()] == [("a", "b")]


def test_shapes_up_to_each_year_without_a_graph_per_year(spark):
    from litloom.operators import temporal

    r = random.Random(5)
    seen = [(*r.sample(range(40), 2), 2000 + r.randint(0, 11)) for _ in range(130)] + [(7, 7, 2003), (50, 51, 2004), (51, 50, 2009)]
    ids = [(v, y) for a, b, y in seen for v in (a, b)] + [(90, 2001), (91, 2030)]
    born = {v: min(y for u, y in ids if u == v) for v, _ in ids}
    want = {}
    for year in set(born.values()):
        n = neighbours([x for x in seen if x[2] <= year])
        now = [v for v, y in born.items() if y <= year]
        c = [2 * sum(b in n[a] for a, b in itertools.combinations(n[v], 2)) / (len(n[v]) * (len(n[v]) - 1)) if len(n[v]) > 1 else 0 for v in now]
        left, parts = set(now), 0
        while left:
            todo, parts = [left.pop()], parts + 1
            while todo:
                new = n[todo.pop()] & left
                left -= new
                todo += new
        want[year] = (round(sum(c) / len(now), 9), parts)
    sc = spark.sparkContext
    sc.setJobGroup("shapes", "")
    got = temporal.network_shapes(spark.createDataFrame(seen, "src long, dst long, year int"), spark.createDataFrame(ids, "id long, year int")).collect()
    jobs = len(sc.statusTracker().getJobIdsForGroup("shapes"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert {x["year"]: (round(x["avg_clustering"], 9), x["n_components"]) for x in got} == want
    assert len(want) > 4 and jobs < 100  # a graph for each year took hundreds


def test_coupled_counts_what_is_shared_and_moves_no_pairs(spark):
    r = random.Random(9)
    works = {p: set(r.sample(range(300), r.randint(0, 5))) | {w for w in range(8) if r.random() < 0.3} for p in range(150)}
    works[150], works[151] = set(range(0, 290, 3)), set(range(0, 300, 2))
    rows = [(f"w{w}", p) for p, ws in works.items() for w in ws] + [("w1", 3), ("w1", 3), (None, 4), ("w2", None)]
    works[3].add(1)
    want = {(a, b): len(works[a] & works[b]) for a, b in itertools.combinations(works, 2) if len(works[a] & works[b]) > 1}
    d = spark.createDataFrame(rows, "c string, i long")
    for tile, most in ((2048, 64), (8, 64), (8, 4), (2048, 1)):
        got = [tuple(x) for x in pairs.coupled(d, "c", "i", tile, most).collect()]
        assert len(got) == len(want) and {x[:2]: x[2] for x in got} == want
    # 400 papers that share one work each with all others: their pairs are never formed.
    lone = spark.createDataFrame([("hub", i) for i in range(400)] + [("x", 1), ("x", 2)], "c string, i long")
    got = pairs.coupled(lone, "c", "i")
    assert [tuple(x) for x in got.collect()] == [(1, 2, 2)]
