"""Graphs as frames: vertices ``id``, edges ``src, dst, weight``.

Iterations cut their lineage with checkpoints in shared storage.
"""

from __future__ import annotations

import heapq
import random
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from litloom.runtime import cut


def simple(edges: DataFrame) -> DataFrame:
    """[G1, G3, G4, G8] Undirected edges once, weights summed, self-loops kept."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1)
    d = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), w.alias("weight"))
    return d.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; a self-loop once."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1)
    ends = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))
    one = F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")))
    return edges.select(F.explode(F.when(F.col("src") == F.col("dst"), one).otherwise(ends)).alias("x"), w.alias("weight")).select("x.a", "x.b", "weight")


def degrees(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """[G9] ``id, degree, strength`` over simple edges; a self-loop counts two; isolates 0 where vertices are given."""
    w = F.col("weight") if "weight" in edges.columns else F.lit(1)
    d = edges.select(F.explode(F.array("src", "dst")).alias("id"), w.alias("w")).groupBy("id").agg(F.count("*").alias("degree"), F.sum("w").cast("double").alias("strength"))
    if vertices is None:
        return d
    return vertices.select("id").distinct().join(d, "id", "left").fillna({"degree": 0, "strength": 0.0})


def degree_centrality(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """[G10] ``id, degree, centrality``: degree / (n - 1); 1 in a graph of one vertex."""
    d = degrees(edges, vertices)
    n = d.agg((F.count("*") - 1).alias("_n"))
    return d.join(F.broadcast(n), F.lit(True)).select("id", "degree", F.when(F.col("_n") > 0, F.col("degree") / F.col("_n")).otherwise(F.lit(1.0)).alias("centrality"))


def size_and_density(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """[G11] ``n, m, density``: 2m / (n (n - 1)), 0 for up to one vertex."""
    n, m = vertices.select("id").distinct().agg(F.count("*").alias("n")), edges.agg(F.count("*").alias("m"))
    k = F.col("n") * (F.col("n") - 1)
    return n.join(F.broadcast(m), F.lit(True)).withColumn("density", F.when(k > 0, 2.0 * F.col("m") / k).otherwise(F.lit(0.0)))


def clustering(edges: DataFrame) -> DataFrame:
    """[G12] ``id, triangles, coefficient`` of vertices with an edge; 0 below degree two; self-loops ignored.

    Edges point from the smaller to the larger degree, so that a hub emits
    few two-paths (at most the square root of twice the edges per vertex).
    """
    e = cut(simple(edges).filter("src <> dst").select("src", "dst"))
    deg = degrees(e).select("id", "degree")
    a = e.join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    o = cut(a.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    p, q = o.select(F.col("a"), F.col("b").alias("x")), o.select(F.col("a"), F.col("b").alias("y"))
    wedge = p.join(q, "a").filter("x < y")
    tri = wedge.join(e.select(F.col("src").alias("x"), F.col("dst").alias("y")), ["x", "y"]).select(F.explode(F.array("a", "x", "y")).alias("id"))
    t = tri.groupBy("id").agg(F.count("*").alias("triangles"))
    k = F.col("degree") * (F.col("degree") - 1)
    return deg.join(t, "id", "left").select(
        "id", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.when(k > 0, 2.0 * F.coalesce("triangles", F.lit(0)) / k).otherwise(F.lit(0.0)).alias("coefficient")
    )


def triangle_years(edges: DataFrame) -> DataFrame:
    """[G12] ``id, year``: the three vertices of every triangle, in the year of its latest edge.

    ``edges``: s, d, year; every pair once, no loops.  They point from the
    smaller to the larger degree, as in ``clustering``.
    """
    deg = edges.select(F.explode(F.array("s", "d")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    a = edges.join(deg.select(F.col("id").alias("s"), F.col("n").alias("ds")), "s").join(deg.select(F.col("id").alias("d"), F.col("n").alias("dd")), "d")
    up = F.struct("ds", "s") < F.struct("dd", "d")
    o = cut(a.select(F.when(up, F.col("s")).otherwise(F.col("d")).alias("a"), F.when(up, F.col("d")).otherwise(F.col("s")).alias("b"), "year"))
    p, q = o.select("a", F.col("b").alias("x"), F.col("year").alias("y1")), o.select("a", F.col("b").alias("z"), F.col("year").alias("y2"))
    wedge = p.join(q, "a").filter("x < z").select("a", F.col("x").alias("s"), F.col("z").alias("d"), F.greatest("y1", "y2").alias("y"))
    tri = wedge.join(edges, ["s", "d"])
    return tri.select(F.explode(F.array("a", "s", "d")).alias("id"), F.greatest("y", "year").alias("year"))


def forest_years(edges: DataFrame) -> DataFrame:
    """[G13] ``year, n``: edges per year of a spanning forest that is as early as can be.

    ``edges``: s, d, year; every pair once, s < d.  In a round (Boruvka) every
    vertex takes its first edge by (year, s, d), and what is joined becomes
    one vertex; at most half of the vertices are left.
    """
    e, total = edges, defaultdict(int)
    while not e.isEmpty():
        first = e.select(F.explode(F.array("s", "d")).alias("id"), "year", "s", "d").groupBy("id").agg(F.min(F.struct("year", "s", "d")).alias("x"))
        best = first.select("id", "x.year", F.when(F.col("id") == F.col("x.s"), F.col("x.d")).otherwise(F.col("x.s")).alias("to"))
        back = best.select(F.col("id").alias("to"), F.col("to").alias("back"))
        # Only two that take the same edge lead to one another; the smaller is the root.
        root = (F.col("back") == F.col("id")) & (F.col("id") < F.col("to"))
        state = cut(best.join(back, "to").select("id", "year", F.when(root, F.col("id")).otherwise(F.col("to")).alias("to")))
        for r in state.filter("id <> to").groupBy("year").count().collect():  # one row per year
            total[r["year"]] += r["count"]
        state, settled = state.select("id", "to"), False
        while not settled:
            for _ in range(2):
                state = state.join(state.select(F.col("id").alias("to"), F.col("to").alias("up")), "to").select("id", F.col("to").alias("was"), F.col("up").alias("to"))
                last, state = state, state.select("id", "to")
            last = cut(last)
            settled, state = last.filter("was <> to").isEmpty(), last.select("id", "to")
        j = e.join(state.select(F.col("id").alias("s"), F.col("to").alias("x")), "s").join(state.select(F.col("id").alias("d"), F.col("to").alias("z")), "d").filter("x <> z")
        e = cut(j.groupBy(F.least("x", "z").alias("s"), F.greatest("x", "z").alias("d")).agg(F.min("year").alias("year")))
    return edges.sparkSession.createDataFrame(list(total.items()), f"year {dict(edges.dtypes)['year']}, n long")


def average_clustering(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """[G12] The mean coefficient over all vertices, those without an edge counting 0."""
    c = vertices.select("id").distinct().join(clustering(edges).select("id", "coefficient"), "id", "left")
    return c.agg(F.avg(F.coalesce("coefficient", F.lit(0.0))).alias("avg_clustering"))


def components(edges: DataFrame, vertices: DataFrame | None = None, most_rounds: int = 100) -> DataFrame:
    """[G13] ``id, component``: the smallest id of the component, by minimum labels with pointer jumps."""
    e = cut(both_ways(edges).select("a", "b"))
    state = e.select(F.col("a").alias("id")).distinct().select("id", F.col("id").alias("label"))
    for _ in range(most_rounds):
        low = e.join(state.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = state.join(low, F.col("id") == F.col("a")).select("id", "label", F.least("label", "low").alias("next"))
        up = step.select(F.col("id").alias("next"), F.col("next").alias("up"))
        step = cut(step.join(up, "next").select("id", "label", F.least("next", "up").alias("next")))
        state = step.select("id", F.col("next").alias("label"))
        if not step.filter("next <> label").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    state = state.withColumnRenamed("label", "component")
    if vertices is None:
        return state
    return vertices.select("id").distinct().join(state, "id", "left").withColumn("component", F.coalesce("component", "id"))


def component_summary(members: DataFrame) -> DataFrame:
    """[G13] ``n_components, largest``."""
    return members.groupBy("component").count().agg(F.count("*").alias("n_components"), F.max("count").alias("largest"))


def without_isolates(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices with an edge."""
    return vertices.join(edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct(), "id", "left_semi")


def induced(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """[F16, F19, G21, T5] Edges whose two ends are kept."""
    k = keep.select(F.col("id").alias("_k")).distinct()
    return edges.join(k, edges["src"] == k["_k"], "left_semi").join(k, F.col("dst") == k["_k"], "left_semi")


def without(edges: DataFrame, terms: list[str]) -> DataFrame:
    """[F17, G20] Edges that touch none of a short list of vertices."""
    return edges.filter(~F.col("src").isin(*terms) & ~F.col("dst").isin(*terms))


def neighbours(edges: DataFrame, start: DataFrame, kinds: DataFrame | None = None, kind: str | None = None) -> DataFrame:
    """[G22] Distinct ids next to the start's ids, of one kind if asked."""
    n = both_ways(edges).join(start.select(F.col("id").alias("a")).distinct(), "a", "left_semi").select(F.col("b").alias("id")).distinct()
    return n if kind is None else n.join(kinds.filter(F.col("type") == kind).select("id"), "id", "left_semi")


def peripheral(edges: DataFrame, vertices: DataFrame, k: int = 10, by: str = "centrality") -> DataFrame:
    """[G23, T4] The k of the given vertices that are least central in the graph, with the vertices' columns; ties by id."""
    return degree_centrality(edges).join(vertices, "id").orderBy(by, "id").limit(k)


def eigenvector(edges: DataFrame, steps: int = 500, tol: float = 1e-6) -> DataFrame:
    """[G15] ``id, centrality`` by power iteration of the weighted adjacency plus identity; length 1; 0 where it doesn't settle."""
    e = cut(both_ways(edges))
    x = cut(e.select(F.col("a").alias("id")).distinct().withColumn("v", F.lit(1.0)))
    n = x.count()
    if not n:
        return x.select("id", F.col("v").alias("centrality"))
    done = False
    for _ in range(steps):
        push = e.join(x.select(F.col("id").alias("b"), "v"), "b").groupBy("a").agg(F.sum(F.col("weight") * F.col("v")).alias("p"))
        y = x.join(push, F.col("id") == F.col("a")).select("id", F.col("v").alias("old"), (F.col("v") + F.col("p")).alias("v"))
        norm = y.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("_l"))
        y = cut(y.join(F.broadcast(norm), F.lit(True)).select("id", "old", (F.col("v") / F.col("_l")).alias("v")))
        change = y.agg(F.sum(F.abs(F.col("v") - F.col("old")))).first()[0]
        x = y.select("id", "v")
        if change < n * tol:
            done = True
            break
    return x.select("id", (F.col("v") if done else F.lit(0.0)).alias("centrality"))


def _brandes(adj: dict, source, weighted: bool) -> dict:
    """Dependencies of one source (shortest paths counted, then accumulated backwards)."""
    sigma, dist, before, order = defaultdict(float), {source: 0.0}, defaultdict(list), []
    sigma[source] = 1.0
    heap, seen, tick = [(0.0, 0, source)], set(), 0
    while heap:
        d, _, v = heapq.heappop(heap)
        if v in seen:
            continue
        seen.add(v)
        order.append(v)
        for w, c in adj.get(v, ()):
            if w == v:
                continue
            nd = d + (c if weighted else 1.0)
            if w not in dist or nd < dist[w] - 1e-12:
                dist[w], sigma[w], before[w] = nd, sigma[v], [v]
                tick += 1
                heapq.heappush(heap, (nd, tick, w))
            elif w not in seen and abs(nd - dist[w]) <= 1e-12:
                sigma[w] += sigma[v]
                before[w].append(v)
    delta = defaultdict(float)
    for w in reversed(order):
        for v in before[w]:
            delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
    delta.pop(source, None)
    return delta


MOST_EDGES = 5_000_000  # edges of a graph whose adjacency is sent to every task


def betweenness(edges: DataFrame, weighted: bool = False, invert: bool = False, normalised: bool = True) -> DataFrame:
    """[G14] ``id, betweenness``, exact: sources are spread over tasks, each task holds the adjacency.

    With ``weighted`` the weight is read as a length (``invert``: as its
    reciprocal).  The graph's size is checked; larger graphs are refused.
    """
    spark = edges.sparkSession
    e = simple(edges)
    m = e.limit(MOST_EDGES + 1).count()
    if m > MOST_EDGES:
        raise ValueError(f"betweenness sends the graph to every task: at most {MOST_EDGES} edges")
    adj: dict = defaultdict(list)
    for r in e.collect():  # size checked above
        c = float(r["weight"])
        c = 1.0 / c if invert and c else c
        adj[r["src"]].append((r["dst"], c))
        if r["src"] != r["dst"]:
            adj[r["dst"]].append((r["src"], c))
    shared = spark.sparkContext.broadcast(dict(adj))
    kind = dict(e.dtypes)["src"]

    def run(parts):
        total: dict = defaultdict(float)
        for pdf in parts:
            for s in pdf["id"]:
                for v, x in _brandes(shared.value, s, weighted).items():
                    total[v] += x
        yield pd.DataFrame({"id": list(total), "b": [float(x) for x in total.values()]})

    ids = e.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    n = ids.count()
    scale = 0.5 if not normalised else (1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0)
    parts = ids.repartition(spark.sparkContext.defaultParallelism * 2).mapInPandas(run, f"id {kind}, b double")
    got = parts.groupBy("id").agg(F.sum("b").alias("b"))
    return ids.join(got, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def modularity(edges: DataFrame, members: DataFrame, resolution: float = 1.0) -> DataFrame:
    """[G17] Weighted modularity of ``members`` (id, community), in two aggregations."""
    w = edges.select("src", "dst", (F.col("weight") if "weight" in edges.columns else F.lit(1)).cast("double").alias("w"))
    s, d = members.select(F.col("id").alias("src"), F.col("community").alias("cs")), members.select(F.col("id").alias("dst"), F.col("community").alias("cd"))
    j = w.join(s, "src").join(d, "dst")
    intra = j.groupBy("cs").agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("w")).otherwise(0.0)).alias("inside")).withColumnRenamed("cs", "c")
    ends = j.select(F.explode(F.array("cs", "cd")).alias("c"), "w").groupBy("c").agg(F.sum("w").alias("deg"))
    m = w.agg(F.sum("w").alias("m"))
    t = ends.join(intra, "c", "left").join(F.broadcast(m), F.lit(True))
    return t.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("deg") / (2 * F.col("m")), 2)).alias("modularity"))


def louvain_local(edges: list[tuple], seed: int = 42, resolution: float = 1.0) -> dict:
    """Louvain on one machine: local moves in a seeded order, then merged communities, until nothing improves."""
    adj: dict = defaultdict(lambda: defaultdict(float))
    for s, d, w in edges:
        adj[s][d] += w
        if s != d:
            adj[d][s] += w
    group = {v: v for v in adj}
    rng = random.Random(seed)
    total = sum(w for v in adj for u, w in adj[v].items()) + sum(adj[v].get(v, 0.0) for v in adj)
    while True:
        deg = {v: sum(ws.values()) + ws.get(v, 0.0) for v, ws in adj.items()}
        com = {v: v for v in adj}
        mass = dict(deg)
        moved, any_move = True, False
        order = sorted(adj)
        rng.shuffle(order)
        while moved:
            moved = False
            for v in order:
                own = com[v]
                near: dict = defaultdict(float)
                for u, w in adj[v].items():
                    if u != v:
                        near[com[u]] += w
                mass[own] -= deg[v]
                gain = {c: w - resolution * deg[v] * mass[c] / total for c, w in near.items()}
                gain.setdefault(own, -resolution * deg[v] * mass[own] / total)
                best = min(gain, key=lambda c: (-gain[c], c))
                if gain[best] <= gain[own] + 1e-12:
                    best = own
                mass[best] += deg[v]
                if best != own:
                    com[v], moved, any_move = best, True, True
        if not any_move:
            return group
        group = {v: com[g] for v, g in group.items()}
        merged: dict = defaultdict(lambda: defaultdict(float))
        for v, ws in adj.items():
            for u, w in ws.items():
                # An inner edge is seen from both its ends; a loop from one.
                merged[com[v]][com[u]] += w / 2 if com[v] == com[u] and u != v else w
        adj = merged


def louvain(edges: DataFrame, seed: int = 42, resolution: float = 1.0, most_local: int = 500_000, sweeps: int = 12) -> DataFrame:
    """[G16] ``id, community``; communities are numbered by size, then smallest id.

    A graph of up to ``most_local`` edges is partitioned on the driver.  A
    larger one is first coarsened by distributed synchronous moves (each vertex
    joins the neighbouring community of largest gain, only towards a smaller
    label in odd and a larger one in even sweeps, which keeps pairs from
    swapping), and the coarse graph then goes the same way.  Where nothing
    merges any more, the partition reached is the result, whatever its size.
    """
    spark = edges.sparkSession
    e = cut(simple(edges))
    kind = dict(e.dtypes)["src"]
    if e.limit(most_local + 1).count() <= most_local:
        part = louvain_local([(r["src"], r["dst"], float(r["weight"])) for r in e.collect()], seed, resolution)
        members = spark.createDataFrame([(v, str(c)) for v, c in part.items()], f"id {kind}, c string")
    else:
        com = _moves(e, sweeps, resolution)
        s, d = com.select(F.col("id").alias("src"), F.col("c").alias("cs")), com.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        coarse = e.join(s, "src").join(d, "dst").select(F.col("cs").alias("src"), F.col("cd").alias("dst"), "weight")
        n0, n1 = com.count(), com.select("c").distinct().count()
        if n1 == n0:  # nothing merges any more: the vertices are the communities
            members = com.select("id", F.col("c").cast("string").alias("c"))
        else:
            upper = cut(louvain(coarse, seed, resolution, most_local, sweeps))
            members = com.join(upper.select(F.col("id").alias("c"), F.col("community").cast("string").alias("up")), "c").select("id", F.col("up").alias("c"))
    sizes = members.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    ranked = sizes.select("c", (F.row_number().over(Window.orderBy(F.desc("n"), "low")) - 1).cast("int").alias("community"))
    return members.join(ranked, "c").select("id", "community")


def _moves(e: DataFrame, sweeps: int, resolution: float) -> DataFrame:
    """Synchronous local moves until none is left, ``sweeps`` at most; lineage is cut in every sweep."""
    ways = cut(both_ways(e).filter("a <> b"))
    deg = cut(degrees(e).select("id", F.col("strength").alias("k")))
    total = deg.agg(F.sum("k")).first()[0]
    com, still = deg.select("id", F.col("id").alias("c")), False
    for i in range(sweeps):
        mass = com.join(deg, "id").groupBy("c").agg(F.sum("k").alias("mass"))
        near = ways.join(com.select(F.col("id").alias("b"), "c"), "b").groupBy("a", "c").agg(F.sum("weight").alias("w"))
        own = com.select(F.col("id").alias("a"), F.col("c").alias("mine")).join(deg.withColumnRenamed("id", "a"), "a")
        g = near.join(own, "a").join(mass, "c")
        rest = F.col("mass") - F.when(F.col("c") == F.col("mine"), F.col("k")).otherwise(0.0)
        g = g.withColumn("gain", F.col("w") - resolution * F.col("k") * rest / total)
        way = (F.col("c") <= F.col("mine")) if i % 2 == 0 else (F.col("c") >= F.col("mine"))
        best = g.filter(way).groupBy("a").agg(F.max_by("c", "gain").alias("to"), F.max("gain").alias("top"), F.max(F.when(F.col("c") == F.col("mine"), F.col("gain"))).alias("stay"))
        best = best.filter(F.col("top") > F.coalesce("stay", F.lit(0.0)) + 1e-12).select(F.col("a").alias("id"), "to")
        best = cut(best)
        if not best.limit(1).count():
            if still:  # neither direction moves a vertex
                return com
            still = True
            continue
        still = False
        com = cut(com.join(best, "id", "left").select("id", F.coalesce("to", "c").alias("c")))
    return com


def callon(edges: DataFrame, members: DataFrame, counts: DataFrame, label_terms: int = 3) -> DataFrame:
    """[G18, T7] Density and centrality of communities by the equivalence index c_ij^2 / (c_i c_j).

    ``members``: id, community; ``counts``: id, n.  Density is 100 x the mean
    inner index (0 without inner edges), centrality 10 x the sum of outer ones.
    """
    m = members.join(counts, "id")
    s = m.select(F.col("id").alias("src"), F.col("community").alias("cs"), F.col("n").alias("ns"))
    d = m.select(F.col("id").alias("dst"), F.col("community").alias("cd"), F.col("n").alias("nd"))
    j = edges.filter("src <> dst").join(s, "src").join(d, "dst").withColumn("e", F.col("weight") * F.col("weight") / (F.col("ns") * F.col("nd")).cast("double"))
    inner = j.filter("cs = cd").groupBy(F.col("cs").alias("community")).agg(F.avg("e").alias("inner"))
    outer = j.filter("cs <> cd").select(F.explode(F.array("cs", "cd")).alias("community"), "e").groupBy("community").agg(F.sum("e").alias("outer"), F.avg("e").alias("mean_outer"))
    rank = F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "id"))
    names = m.withColumn("r", rank).filter(F.col("r") <= label_terms).groupBy("community").agg(F.array_sort(F.collect_list(F.struct("r", "id"))).alias("t"))
    sizes = m.groupBy("community").agg(F.count("*").alias("size"))
    out = sizes.join(inner, "community", "left").join(outer, "community", "left").join(names, "community")
    zero = F.lit(0.0)
    return out.select(
        "community", "size",
        (10.0 * F.coalesce("outer", zero)).alias("centrality"),
        (100.0 * F.coalesce("inner", zero)).alias("density"),
        (100.0 * F.coalesce("mean_outer", zero)).alias("mean_external"),
        F.array_join(F.transform("t", lambda x: x["id"].cast("string")), ", ").alias("label"),
    )


def of_types(vertices: DataFrame, edges: DataFrame, *types: str) -> tuple[DataFrame, DataFrame]:
    """Vertices of the given types (gaps, for instance) and the edges whose two ends are such."""
    keep = vertices.filter(F.col("type").isin(*types))
    return keep, induced(edges, keep)
