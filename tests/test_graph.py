"""Transfer graph: membership and enumeration against a brute-force path search."""

import random

import pytest

from ledgerscope.operators.graph import (build_transfer_graph, detect_cycles, detect_layering, enumerate_chains, hop_summary,
                                         least_chains)
from ledgerscope.operators.paths import chain_relation, cyclic_core, least_cycles, path_counts, paths_from
from tests.conftest import day, make_txn


def paths(edges, max_hops=4):
    adj = {}
    for s, d in edges:
        adj.setdefault(s, []).append(d)
    out = set()

    def go(path):
        if len(path) - 1 >= 2:
            out.add(tuple(path))
        if len(path) - 1 == max_hops:
            return
        for n in adj.get(path[-1], []):
            if n not in path:
                go(path + [n])
    for s in list(adj):
        go([s])
    return out


def edge_df(spark, edges):
    return spark.createDataFrame([(s, d, f"{s}{d}", 1.0) for s, d in edges], "src STRING, dst STRING, txn_id STRING, "
                                                                            "amount DOUBLE")


def test_layering_and_chains_match_brute_force(spark):
    rnd = random.Random(3)
    nodes = [f"N{i:02d}" for i in range(25)]
    edges = set()
    while len(edges) < 45:
        a, b = rnd.sample(nodes, 2)
        edges.add((a, b))
    edges = sorted(edges)
    e = edge_df(spark, edges)
    p = paths(edges)
    chains = {r.originator: r for r in least_chains(e).collect()}
    lay = {r.customer_id: r.chain for r in detect_layering(e).collect()}
    starters = {x[0] for x in p}
    assert set(lay) == starters
    for a, chain in lay.items():
        least = min(x for x in p if x[0] == a and len(x) == 3)
        assert chain == "->".join(least)
        while len(least) < 5:  # each further hop goes to the least receiver off the chain
            free = [d for s, d in edges if s == least[-1] and d not in least]
            if not free:
                break
            least += (min(free),)
        got = chains.pop(a)
        assert got.chain == "->".join(least) and got.hops == len(least) - 1 and got.target == least[-1]
        assert got.txn_ids == ",".join(x + y for x, y in zip(least, least[1:]))
    assert not chains


GRAPHS = [(25, 45), (8, 40), (6, 30), (12, 60), (40, 60), (5, 20)]  # up to complete graphs: reciprocal edges, triangles, squares


def random_edges(seed, n, m):
    rnd = random.Random(seed)
    return sorted({tuple(rnd.sample([f"N{i:02d}" for i in range(n)], 2)) for _ in range(m * 3)})[:m] if n * (n - 1) > m else [
        (f"N{a:02d}", f"N{b:02d}") for a in range(n) for b in range(n) if a != b]


@pytest.mark.parametrize("n,m", GRAPHS)
def test_path_counts_match_listed_paths(spark, n, m):
    edges = random_edges(n, n, m)
    e, listed = edge_df(spark, edges), paths(edges)
    want = {}
    for p in listed:
        for k in range(len(p) - 1):
            key = (p[k], p[k + 1], len(p) - 1, k + 1)
            want[key] = want.get(key, 0) + 1
    counts = path_counts(e)
    rows = counts.collect()
    assert {(r.src, r.dst) for r in rows} == set(edges) and all(r.txn_id == r.src + r.dst for r in rows)
    got = {(r.src, r.dst, hops, k): r[f"n{hops}_{k}"] for r in rows for hops in (2, 3, 4) for k in range(1, hops + 1)}
    assert {k: v for k, v in got.items() if v} == want and min(got.values()) >= 0
    for max_hops in (2, 3, 4):
        rel = chain_relation(counts, max_hops).collect()
        assert len(rel) <= max_hops * len(edges)
        assert {(r.hop, r.src, r.dst): r.paths for r in rel} == {
            (k, s, d): v for k in range(1, max_hops + 1) for s, d in edges for v in [sum(want.get((s, d, h, k), 0) for h in range(2, max_hops + 1))] if v}
    for r in hop_summary(e).collect():
        mine = [len(x) - 1 for x in listed if x[0] == r.customer_id]
        assert (r.receivers, r.two_hop_paths, r.three_hop_paths, r.four_hop_paths) == (
            sum(s == r.customer_id for s, _ in edges), mine.count(2), mine.count(3), mine.count(4))


def test_chain_relation_is_that_of_the_listed_paths(spark):
    edges = random_edges(3, 10, 30)
    e = edge_df(spark, edges)
    some = spark.createDataFrame([("N00",), ("N03",), ("N03",), ("missing",), (None,)], "node STRING")
    got = sorted((r.chain, r.hops, r.originator, r.target, r.txn_ids) for r in paths_from(e, some).collect())
    assert got == sorted(("->".join(p), len(p) - 1, p[0], p[-1], ",".join(a + b for a, b in zip(p, p[1:])))
                         for p in paths(edges) if p[0] in ("N00", "N03"))
    assert sum(r.paths for r in enumerate_chains(e).where("hop = 1").collect()) == len(paths(edges))


def test_path_counts_of_a_hub_are_products_of_degrees(spark):
    """A hub with 3 000 senders and 3 000 receivers has 9 000 000 paths of two; nothing of that size is made."""
    n = 3_000
    e = spark.range(n).selectExpr("concat('a', id) src", "'HUB' dst", "concat('s', id) txn_id", "1D amount").unionByName(
        spark.range(n).selectExpr("'HUB' src", "concat('b', id) dst", "concat('t', id) txn_id", "1D amount"))
    r = path_counts(e).agg({"n2_1": "sum", "n2_2": "sum", "n3_1": "sum", "n4_1": "sum"}).first().asDict()
    assert r == {"sum(n2_1)": n * n, "sum(n2_2)": n * n, "sum(n3_1)": 0, "sum(n4_1)": 0}


def brute_members(edges):
    adj, best = {}, {}
    for s, d in edges:
        adj.setdefault(s, []).append(d)

    def go(path):
        for n in adj.get(path[-1], []):
            if n == path[0] and len(path) >= 3:
                best[path[0]] = min(best.get(path[0], (9,)), (len(path), *path))
            elif n not in path and len(path) < 4:
                go(path + [n])
    for s in list(adj):
        go([s])
    return {(k, v[0], "->".join((*v[1:], k))) for k, v in best.items()}


def test_every_member_of_a_cycle_has_its_least_cycle(spark):
    rnd = random.Random(8)
    hub = [x for i in range(100) for x in (("HUB", f"A{i:03d}"), (f"A{i:03d}", f"B{i:03d}"), (f"B{i:03d}", "HUB"))]
    tail = [("T0", "T1"), ("T1", "HUB"), ("B001", "U0"), ("U0", "U1")]
    for edges in (hub, hub + tail, *(sorted({tuple(rnd.sample([f"N{i:02d}" for i in range(n)], 2)) for _ in range(m)})
                                     for n, m in ((12, 40), (30, 90), (9, 60), (30, 70)))):
        got = {(r.cycle_start, r.length, r.cycle) for r in detect_cycles(edge_df(spark, edges)).collect()}
        assert got == brute_members(edges)


def test_a_hub_of_many_triangles(spark):
    """100 000 triangles through one customer: all 200 001 members have a row, with bounded tasks."""
    n = 100_000
    tri = spark.range(n).selectExpr("concat('a', id) a", "concat('b', id) b")
    e = tri.selectExpr("'HUB' src", "a dst", "concat('1', a) txn_id", "1D amount").unionByName(
        tri.selectExpr("a src", "b dst", "concat('2', a) txn_id", "1D amount")).unionByName(
        tri.selectExpr("b src", "'HUB' dst", "concat('3', a) txn_id", "1D amount"))
    found = detect_cycles(e)
    r = found.selectExpr("count(*) n", "count(distinct cycle_start) members", "min(length) lo", "max(length) hi").first()
    assert tuple(r) == (2 * n + 1, 2 * n + 1, 3, 3)
    assert found.where("cycle_start = 'a7'").first().cycle == "a7->b7->HUB->a7"


def test_the_core_keeps_cycles_and_drops_tails(spark):
    chain = [(f"C{i:02d}", f"C{i + 1:02d}") for i in range(12)]
    ring = [("R1", "R2"), ("R2", "R3"), ("R3", "R1")]
    e = edge_df(spark, chain + ring + [("C05", "R1"), ("R2", "D1")])
    assert {(r.src, r.dst) for r in cyclic_core(e, least_share=0.0).collect()} == set(ring)
    assert set(ring) <= {(r.src, r.dst) for r in cyclic_core(e, rounds=1).collect()}
    assert cyclic_core(edge_df(spark, [("A", "B")])).count() == 0


def test_two_cycle_not_flagged_three_cycle_once(spark):
    e = edge_df(spark, [("A", "B"), ("B", "A"), ("C", "D"), ("D", "E"), ("E", "C")])
    lay = {r.customer_id for r in detect_layering(e).collect()}
    assert lay == {"C", "D", "E"}  # A->B->A is not simple
    cyc = [(r.cycle_start, r.cycle, r.length) for r in detect_cycles(e).collect()]
    assert sorted(cyc) == [("C", "C->D->E->C", 3), ("D", "D->E->C->D", 3), ("E", "E->C->D->E", 3)]


def test_graph_from_transactions_keeps_latest_parallel_edge_and_drops_self(spark):
    rows = [("t1", "C1", day(1), 100, "transfer", "ACC_C2"), ("t2", "C1", day(2), 100, "transfer", "ACC_C2"),
            ("t3", "C2", day(1), 100, "transfer", "ACC_C2"), ("t4", "C2", day(3), 100, "transfer", "EXT9"),
            ("t5", "C3", day(1), 100, "deposit", "ACC_C1")]
    g = {(r.src, r.dst): r.txn_id for r in build_transfer_graph(make_txn(spark, rows)).collect()}
    assert g == {("C1", "C2"): "t2", ("C2", "EXT9"): "t4"}


def test_layering_evidence_rows(spark):
    from ledgerscope.operators.graph import layering_evidence
    e = edge_df(spark, [("A", "B"), ("B", "C")])
    ev = {(r.customer_id, r.transaction_id) for r in layering_evidence(detect_layering(e)).collect()}
    assert ev == {("A", "AB"), ("A", "BC")}


@pytest.mark.parametrize("work", [path_counts, least_cycles])
def test_open_wedges_are_not_written(spark, monkeypatch, work):
    """Three layers, each node sending to all of the next, and one triangle: of some 8 000 wedges one pair closes."""
    from ledgerscope.operators import paths as module
    n = 20
    edges = [(f"{x}{i:02d}", f"{y}{j:02d}") for x, y in (("A", "B"), ("B", "C")) for i in range(n) for j in range(n)] + [("C07", "A03")]
    written, cut = [], module.cut_lineage

    def counted(df, *a):
        out = cut(df, *a)
        written.append(out.count())
        return out
    monkeypatch.setattr(module, "cut_lineage", counted)
    rows = work(edge_df(spark, edges)).collect()
    assert max(written) <= len(edges)
    if work is path_counts:
        want = {}
        for p in paths(edges):
            if len(p) == 4:
                want[p[1], p[2]] = want.get((p[1], p[2]), 0) + 1
        assert {(r.src, r.dst): r.n3_2 for r in rows if r.n3_2} == want
    else:
        assert {(r.node, "->".join(r.nodes), ",".join(r.txns)) for r in rows} == {
            (k, "->".join((k, *rest)), ",".join(t)) for k, rest, t in (
                ("A03", ("B00", "C07"), ("A03B00", "B00C07", "C07A03")), ("C07", ("A03", "B00"), ("C07A03", "A03B00", "B00C07")),
                *((f"B{j:02d}", ("C07", "A03"), (f"B{j:02d}C07", "C07A03", f"A03B{j:02d}")) for j in range(n)))}


def test_nodes_are_numbered_in_the_order_of_their_names(spark):
    from ledgerscope.operators.paths import numbered
    e = edge_df(spark, [("b", "a"), ("é", "Z"), ("Z", "b"), ("a10", "a9")]).repartition(4)
    _, nodes, by_number = numbered(e)
    rows = sorted((r.id, r.node, r.out) for r in nodes.collect())
    assert [r[1] for r in rows] == sorted(r[1] for r in rows) and dict(r[1:] for r in rows)["Z"] == 1
    name = {r[0]: r[1] for r in rows}
    assert {(name[r.src], name[r.dst]) for r in by_number.collect()} == {("b", "a"), ("é", "Z"), ("Z", "b"), ("a10", "a9")}
