import random
from collections import defaultdict

import pytest

from litloom.llm import mixing, packing


def sizes(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, pack_id int, slot int")


@pytest.mark.parametrize("rule", ["residual", "dot"])
def test_containers_are_valid_and_full(spark, rule):
    r = random.Random(4)
    rows = [(i, "s", r.choice((0, 30, 60, 120, 250, 900)) + r.randint(0, 40), 9, 9) for i in range(3000)] + [(5000, "s", 0, 1, 1), (5001, "s", None, 1, 1), (5002, "s", 5000, 1, 1)]
    caps = [(1, 256), (2, 2048)]
    d = sizes(spark, rows)
    got = packing.pack(d, caps, block_rows=800, rule=rule, docs_per_token=1.0, cost_share=1.0)
    pieces, load = defaultdict(list), defaultdict(list)
    for x in got.collect():
        pieces[x["pack_id"], x["doc_id"]].append((x["start_token"], x["n_tokens"], x["piece"]))
        load[x["pack_id"], x["container_id"]].append(x["n_tokens"])
    for p, c in caps:
        for i, _, n, *_ in rows:
            if n:
                part = sorted(pieces[p, i])
                assert sum(x[1] for x in part) == n and (len(part) == 1) == (n <= c) and part[0][0] == 0 and [x[2] for x in part] == list(range(len(part)))
            else:
                assert (p, i) not in pieces
    assert all(sum(v) <= dict(caps)[p] for (p, _), v in load.items())
    fill = {x["pack_id"]: x["fill_share"] for x in packing.packing_report(got, caps).collect()}
    assert fill[1] > 0.9 and fill[2] > 0.97


def test_every_constraint_binds():
    got = packing.pack_lengths({10: 40, 50: 10}, 100, 3, 1e9)
    assert all(len(b) <= 3 and sum(b) <= 100 for b in got) and sum(map(len, got)) == 50
    got = packing.pack_lengths({50: 4, 10: 10}, 100, 99, 2600.0)
    assert all(sum(x * x for x in b) <= 2600 for b in got) and sum(map(len, got)) == 14


def test_items_select_among_all_open_containers():
    # 60 and 50 open containers; 40 completes the first and 45 + 5 the second, whichever was opened last.
    assert packing.pack_lengths({60: 1, 50: 1, 45: 1, 40: 1, 5: 1}, 100, 100, 1e9) == [[60, 40], [50, 45, 5]]
    # Equal tokens left: the container with less of the other capacities left is taken.
    assert packing.pack_lengths({70: 1, 35: 2, 30: 1}, 100, 3, 1e9, weights=(1.0, 1.0, 0.0)) == [[70], [35, 35, 30]]
    r = random.Random(3)
    waiting = defaultdict(int)
    for _ in range(4000):
        waiting[min(250, max(3, int(r.lognormvariate(3.6, 1.0))))] += 1
    for rule in ("residual", "dot"):
        got = packing.pack_lengths(dict(waiting), 256, 8, 0.9 * 256**2, rule)
        assert sum(map(len, got)) == 4000
        assert all(sum(b) <= 256 and len(b) <= 8 and (len(b) == 1 or sum(x * x for x in b) <= 0.9 * 256**2) for b in got)
        assert any(len(b) == 8 and sum(b) < 256 for b in got)


def test_registered_limits_bind(spark, sf):
    from litloom.llm import catalog

    at = {r["pack_id"]: r for r in catalog.p8_report(spark, sf).collect()}
    assert sum(r["at_most_docs"] for r in at.values()) > 0 and sum(r["at_most_cost"] for r in at.values()) > 0


def test_nothing_to_pack(spark):
    assert packing.pack(sizes(spark, []), [(1, 10)]).count() == 0 and packing.pack(sizes(spark, [(1, "s", 5, 1, 1)]), []).count() == 0


def test_shares_repeats_and_spread(spark):
    r = random.Random(1)
    rows = [(i, "big", r.randint(20, 200), 1, 1) for i in range(2000)] + [(i, "mid", r.randint(20, 200), 1, 1) for i in range(3000, 3500)] + [(i, "tiny", r.randint(20, 60), 1, 1) for i in range(4000, 4040)]
    rows += [(9000, None, 50, 1, 1), (9001, "other", 50, 1, 1), (9002, "big", 0, 1, 1), (9003, "big", None, 1, 1)]
    targets = [(1, "big", 0.5, 2), (1, "mid", 0.4, 2), (1, "tiny", 0.1, 5), (2, "big", 3.0, 1), (2, "absent", 1.0, 3), (3, "absent", 1.0, 3), (4, "mid", None, 2)]
    got = mixing.mix_sources(sizes(spark, rows), targets).collect()
    tok, uses = defaultdict(int), defaultdict(int)
    for x in got:
        tok[x["mix_id"], x["source"]] += x["n_tokens"]
        uses[x["mix_id"], x["doc_id"], x["use_no"]] += 1
    whole = sum(v for (m, _), v in tok.items() if m == 1)
    for s, share in (("big", 0.5), ("mid", 0.4), ("tiny", 0.1)):
        assert abs(tok[1, s] / whole - share) < 0.01
    assert set(uses.values()) == {1} and max(u for (m, d, u) in uses if m == 1 and d >= 4000) == 5
    assert {s for (m, s) in tok if m == 2} == {"big"} and not [m for (m, _) in tok if m in (3, 4)]
    ones = sorted((x for x in got if x["mix_id"] == 1), key=lambda x: x["slot"])
    half = ones[: len(ones) // 2]
    t = sum(x["n_tokens"] for x in half)
    assert abs(sum(x["n_tokens"] for x in half if x["source"] == "big") / t - 0.5) < 0.05
    report = {(x["mix_id"], x["source"]): x for x in mixing.mix_report(mixing.mix_sources(sizes(spark, rows), targets), spark.createDataFrame(targets, "mix_id int, source string, target_share double, max_repeats int")).collect()}
    assert report[1, "tiny"]["most_uses"] == 5 and report[2, "absent"]["reached_share"] == 0.0


def test_given_size_and_shortfall():
    plan = mixing.plan_mixes([(1, "a", 0.5, 1), (1, "b", 0.5, 2)], {"a": 100, "b": 1000}, 1000)
    assert {p["source"]: p["want"] for p in plan} == {"a": 100, "b": 500.0}
    assert mixing.plan_mixes([], {}) == []


def test_empty_table(spark):
    assert mixing.mix_sources(sizes(spark, []), [(1, "a", 1.0, 1)]).count() == 0


def test_token_counts(spark):
    import os

    from litloom.llm import tokens

    if not os.path.exists(tokens.TOKENIZER):
        pytest.skip("no tokenizer here")
    d = spark.createDataFrame([("hello world",), ("",), (None,), ("<|endoftext|>",), ("word " * 30000,)], "t string")
    n = [x[0] for x in d.select(tokens.token_count(d["t"])).collect()]
    for other in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        m = [x[0] for x in d.select(tokens.token_count(d["t"], os.path.join(os.path.dirname(tokens.TOKENIZER), other))).collect()]
        assert m[1] == m[2] == 0 and (m == n or other.endswith("model"))
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] > 1 and n[4] >= 30000
