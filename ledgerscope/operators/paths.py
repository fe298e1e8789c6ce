"""Closed cycles and simple paths of the transfer graph, counted through every edge without listing a path.

Cycles of three and four are closed from wedges. A wedge begins at the cycle's anchor, its member of the highest
(degree, id), and its other members lie below: a node of high degree is an end of wedges, never the middle of one
between smaller ends, so that there are at most about edges ** 1.5 wedges in all and a hub costs its edges only.

Simple paths of two to four transfers are counted by inclusion and exclusion. The walks through an edge are products
and sums of degrees; the walks that meet themselves are taken off by the edge's reciprocal, its triangles and its
closed cycles of four. Everything is an equi-join on a node or an edge, and one row an edge is the largest result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerscope.session import cut_lineage


def cyclic_core(edges: DataFrame, rounds: int = 20, least_share: float = 0.01) -> DataFrame:
    """The edges left after peeling: each round drops those whose sender has no sender or whose receiver has no receiver.

    An edge of a closed cycle is never dropped. Peeling ends when a round drops less than ``least_share`` of the edges left, or
    after ``rounds``, so a long tail may stay: what is left contains every cycle, and only the work of later steps depends on it.
    Per round two semi-joins on distinct nodes and one written table.
    """
    core = cut_lineage(edges)
    left = core.count()
    for _ in range(rounds):
        fed = core.select(F.col("dst").alias("src")).distinct()
        feeding = core.select(F.col("src").alias("dst")).distinct()
        kept = cut_lineage(core.join(fed, "src", "left_semi").join(feeding, "dst", "left_semi").select(*core.columns))
        before, left, core = left, kept.count(), kept
        if before - left <= least_share * before:
            break
    return core


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out, in): receivers and senders of every node; partial-aggregated, so a hub costs one row a task."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    ends = edges.select(F.col("src").alias("node"), one.alias("out"), none.alias("in")).unionAll(
        edges.select(F.col("dst").alias("node"), none.alias("out"), one.alias("in")))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))


def numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, nodes, e): the edges written; their nodes numbered in the order of their names, written; the edges by these numbers.

    ``nodes``: node, out, in, id. ``e``: src, dst (numbers), txn_id, src_out, src_in, dst_out, dst_in, not written. Wedges and
    sums are then made of numbers, a fraction of the names' bytes, and the least number is the least name.
    """
    edges = cut_lineage(edges.select("src", "dst", "txn_id"))
    nodes = cut_lineage(degrees(edges).where("node is not null").orderBy("node").withColumn("id", F.monotonically_increasing_id()))
    e = edges
    for side in ("src", "dst"):
        e = e.join(nodes.select(F.col("node").alias(side), F.col("id").alias(f"_{side}"), F.col("out").alias(f"{side}_out"), F.col("in").alias(f"{side}_in")), side)
    return edges, nodes, e.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), "txn_id", "src_out", "src_in", "dst_out", "dst_in")


def anchored_wedges(e: DataFrame, first: dict[str, str] | None = None, second: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Wedges anchor v -> m -> y and y -> m -> v with m and y below v, as (v, y, m) and the columns asked for.

    ``e``: src, dst, src_degree, dst_degree. ``first`` and ``second`` name columns of the edge at the anchor's side and of the
    other edge; ``{v}``, ``{m}`` and ``{y}`` in a column stand for its end there.
    """
    def wedges(out: bool) -> DataFrame:
        near, far = ("src", "dst") if out else ("dst", "src")
        below = F.struct(f"{far}_degree", far) < F.struct(f"{near}_degree", near)
        a = e.where(below).select(F.col(near).alias("v"), F.col(f"{near}_degree").alias("v_degree"), F.col(far).alias("m"),
                                  *[F.col(c.format(v=near, m=far)).alias(n) for n, c in (first or {}).items()])
        b = e.select(F.col(near).alias("m"), F.col(far).alias("y"), F.col(f"{far}_degree").alias("y_degree"),
                     *[F.col(c.format(m=near, y=far)).alias(n) for n, c in (second or {}).items()])
        return a.join(b, "m").where(F.struct("y_degree", "y") < F.struct("v_degree", "v")).drop("v_degree", "y_degree")

    return wedges(True), wedges(False)


def closing_pairs(e: DataFrame, outs: DataFrame, ins: DataFrame) -> DataFrame:
    """(v, y, n_out, n_in, closed): anchors and ends with wedges out and either wedges in or an edge y -> v (``closed`` = 1); written.

    Most wedges close nothing. Counted first, their pairs meet as three numbers a row, and only wedges of a pair that is left are
    looked at again; the pairs are written, so Spark knows their size and broadcasts them if they are few.
    """
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    back = e.where(F.struct("src_degree", "src") < F.struct("dst_degree", "dst")).select(F.col("dst").alias("v"), F.col("src").alias("y"))
    ends = functools.reduce(DataFrame.unionAll, [w.select("v", "y", *[one if w is x else none for x in (outs, ins, back)]) for w in (outs, ins, back)])
    return cut_lineage(ends.toDF("v", "y", "n_out", "n_in", "closed").groupBy("v", "y").agg(*[F.sum(c).alias(c) for c in ("n_out", "n_in", "closed")])
                       .where("n_out > 0 and (n_in > 0 or closed > 0)"))


def least_cycles(edges: DataFrame, core: bool = True) -> DataFrame:
    """(node, length, nodes, txns): for every member of a closed cycle of three or four its least one, beginning with it.

    Least is the shorter length first, then the least members in order. The graph is trimmed to its cyclic core first
    (``core``). Of the wedges that close, all meet the least wedges across: each way round an anchor and the member opposite is
    kept for its own middle, and for the other side only the two least ways can follow, since one of them avoids that middle.
    Names and transactions are looked up for the least cycles alone.
    """
    edges, nodes, e = numbered(edges)
    e = e.select("src", "dst", (F.col("src_out") + F.col("src_in")).alias("src_degree"), (F.col("dst_out") + F.col("dst_in")).alias("dst_degree"), "src_in", "dst_out")
    if core:  # the first round of peeling is known from the degrees
        e = cyclic_core(e.where("src_in > 0 and dst_out > 0").drop("src_in", "dst_out"))
    else:
        e = cut_lineage(e.drop("src_in", "dst_out"))
    outs, ins = anchored_wedges(e)
    pairs = closing_pairs(e, outs, ins)
    outs = cut_lineage(outs.join(pairs, ["v", "y"]).select("v", "y", F.col("m").alias("o"), "closed"))
    ins = cut_lineage(ins.join(pairs.where("n_in > 0").select("v", "y"), ["v", "y"]).select("v", "y", F.col("m").alias("i")))

    def two_least(wedges: DataFrame, c: str) -> DataFrame:
        one = wedges.groupBy("v", "y").agg(F.min(c).alias("one"))
        two = wedges.join(one, ["v", "y"]).where(F.col(c) > F.col("one")).groupBy("v", "y").agg(F.min(c).alias("two"))
        return one.join(two, ["v", "y"], "left")

    three = outs.where("closed > 0").select(F.array("v", "o", "y").alias("n"))
    other = lambda own: F.when(F.col("one") != F.col(own), F.col("one")).otherwise(F.col("two"))
    by_out = outs.select("v", "y", "o").join(two_least(ins, "i"), ["v", "y"]).withColumn("i", other("o"))
    by_in = ins.join(two_least(outs, "o"), ["v", "y"]).withColumn("o", other("i"))
    four = (by_out.select("v", "y", "o", "i").unionByName(by_in.select("v", "y", "o", "i")).where("o is not null and i is not null")
            .select(F.array("v", "o", "y", "i").alias("n")))
    turned = lambda k: F.concat(F.slice("n", k + 1, F.size("n")), F.slice("n", 1, k))
    each = three.unionByName(four).select(F.explode(F.transform(F.sequence(F.lit(0), F.size("n") - 1), lambda k: F.struct(
        F.size("n").alias("length"), turned(k).alias("nodes")))).alias("c"))
    least = cut_lineage(each.groupBy(F.col("c.nodes")[0].alias("node")).agg(F.min("c").alias("c")).select("node", "c.length", "c.nodes"))

    steps = least.select("node", "length", F.posexplode("nodes").alias("k", "s"), "nodes").withColumn("d", F.col("nodes")[F.pmod(F.col("k") + 1, F.col("length"))])
    for side in ("src", "dst"):
        steps = steps.join(nodes.select(F.col("id").alias(side[0]), F.col("node").alias(side)), side[0])
    steps = steps.join(edges, ["src", "dst"]).groupBy("node", "length").agg(F.array_sort(F.collect_list(F.struct("k", "src", "txn_id"))).alias("c"))
    return steps.select(F.col("c.src")[0].alias("node"), "length", F.col("c.src").alias("nodes"), F.col("c.txn_id").alias("txns"))


_CLOSED = ("t", "t_out", "t_in", "t_to", "t_from", "q")


def closing_counts(e: DataFrame) -> DataFrame:
    """Per edge u -> w of a closed cycle: triangles w -> z -> u with sums over z, and closed cycles of four through it; written.

    ``t`` triangles, ``t_out`` and ``t_in`` the sums of z's out- and in-degree, ``t_to`` those with u -> z as well, ``t_from``
    those with z -> w as well, ``q`` cycles of four different members. ``e``: src, dst, back, and both ends' out- and in-degree.
    """
    e = e.withColumn("src_degree", F.col("src_out") + F.col("src_in")).withColumn("dst_degree", F.col("dst_out") + F.col("dst_in"))
    outs, ins = anchored_wedges(e, {"b1": "back", "v_out": "{v}_out", "v_in": "{v}_in", "m_out": "{m}_out", "m_in": "{m}_in"},
                                {"b2": "back", "y_out": "{y}_out", "y_in": "{y}_in"})
    pairs = closing_pairs(e, outs, ins)
    outs, ins = outs.join(pairs, ["v", "y"]), ins.join(pairs.where("n_in > 0"), ["v", "y"])
    third = e.select(F.col("dst").alias("v"), F.col("src").alias("y"), F.col("back").alias("b3"))
    tri = outs.where("closed > 0").join(third, ["v", "y"])
    zero = F.lit(0).cast("long")

    def share(u: str, w: str, *values) -> Column:
        return F.struct(F.col(u).alias("src"), F.col(w).alias("dst"), *[F.col(v).alias(c) if isinstance(v, str) else v.alias(c) for c, v in zip(_CLOSED, values)])

    # u -> w with z between w and u: t_to asks for the reverse of z -> u, t_from for the reverse of w -> z
    one = F.lit(1).cast("long")
    corners = tri.select(F.explode(F.array(
        share("v", "m", one, "y_out", "y_in", "b3", "b2", zero),
        share("m", "y", one, "v_out", "v_in", "b1", "b3", zero),
        share("y", "v", one, "m_out", "m_in", "b2", "b1", zero))).alias("c")).select("c.*")

    # a wedge closes with every wedge on the other side, but for the one through its own middle
    def squares(w: DataFrame, n: str, *ends: tuple[str, str]) -> DataFrame:
        w = w.withColumn("q", F.col(n) - F.col("b1") * F.col("b2")).where("q > 0")
        return w.select(F.explode(F.array(*[share(u, x, zero, zero, zero, zero, zero, "q") for u, x in ends])).alias("c")).select("c.*")

    sides = squares(outs, "n_in", ("v", "m"), ("m", "y")).unionByName(squares(ins, "n_out", ("m", "v"), ("y", "m")))
    return cut_lineage(corners.unionByName(sides).groupBy("src", "dst").agg(*[F.sum(c).alias(c) for c in _CLOSED]))


def path_counts(edges: DataFrame) -> DataFrame:
    """(src, dst, txn_id, n2_1, n2_2, n3_1 .. n3_3, n4_1 .. n4_4): ``nL_p`` simple paths of L transfers have the edge as their p-th.

    ``edges`` are distinct pairs without self-transfers (as ``build_transfer_graph`` gives them). Counts are longs. For an edge
    u -> w with r = 1 if w -> u exists, ``ahead`` of w the sum of its receivers' out-degrees less its reciprocal edges (``behind`` of u
    likewise with senders and in-degrees): paths of three from the edge on are ahead(w) - r out(u) + r - triangles, those with it
    in the middle (in(u) - r)(out(w) - r) - triangles; a fourth transfer sums the former over w's receivers and takes off what
    returns to u. The sums are kept by node: an edge meets its two ends once more at the last.
    """
    _, nodes, e = numbered(edges)
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))  # an edge and its reverse
    up = (F.col("src") < F.col("dst")).cast("long")
    e = cut_lineage(e.withColumn("back", F.max(up).over(pair) - F.min(up).over(pair)))
    closed = closing_counts(e)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    by_src = e.groupBy("src").agg(F.sum("dst_out").alias("out2"), F.sum("back").alias("back")).withColumnRenamed("src", "id")
    by_dst = e.groupBy("dst").agg(F.sum("src_in").alias("in2")).withColumnRenamed("dst", "id")
    near = cut_lineage(nodes.join(by_src, "id", "left").join(by_dst, "id", "left").select(
        "id", "node", "out", "in", zero("back").alias("back"), (zero("out2") - zero("back")).alias("ahead"), (zero("in2") - zero("back")).alias("behind")))
    ahead = (e.select("src", "dst").join(near.select(F.col("id").alias("dst"), "ahead"), "dst")
             .groupBy(F.col("src").alias("id")).agg(F.sum("ahead").alias("ahead2")))
    behind = (e.select("src", "dst").join(near.select(F.col("id").alias("src"), "behind"), "src")
              .groupBy(F.col("dst").alias("id")).agg(F.sum("behind").alias("behind2")))
    t_out = closed.groupBy(F.col("src").alias("id")).agg(F.sum("t").alias("t_of_out"))
    t_in = closed.groupBy(F.col("dst").alias("id")).agg(F.sum("t").alias("t_of_in"))
    ends = near
    for part in (ahead, behind, t_out, t_in):
        ends = ends.join(part, "id", "left")
    ends = cut_lineage(ends.select(
        "id", "node", "ahead", "behind",
        (zero("ahead2") - F.col("out") * F.col("back") + F.col("back") - zero("t_of_out")).alias("onward"),
        (zero("behind2") - F.col("in") * F.col("back") + F.col("back") - zero("t_of_in")).alias("inward")))

    reverse = closed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("t").alias("t_back"))
    e = e.join(closed, ["src", "dst"], "left").join(reverse, ["src", "dst"], "left")
    for side, far in (("src", "inward"), ("dst", "onward")):
        e = e.join(ends.select(F.col("id").alias(side), F.col("node").alias(f"{side}_name"), F.col("ahead").alias(f"{side}_ahead"),
                               F.col("behind").alias(f"{side}_behind"), far), side)
    r = F.col("back")
    e = e.select(
        F.col("src_name").alias("src"), F.col("dst_name").alias("dst"), "txn_id", "src_out", "src_in", "dst_out", "dst_in", "onward", "inward",
        r.alias("r"), *[zero(c).alias(c) for c in _CLOSED], (F.col("dst_out") - r).alias("n2_1"), (F.col("src_in") - r).alias("n2_2"),
        (F.col("dst_ahead") - r * F.col("src_out") + r - zero("t")).alias("n3_1"), (F.col("src_behind") - r * F.col("dst_in") + r - zero("t")).alias("n3_3"),
        # the same of the reverse edge, if there is one
        (r * (F.col("src_ahead") - F.col("dst_out") + 1 - zero("t_back"))).alias("r_1"), (r * (F.col("dst_behind") - F.col("src_in") + 1 - zero("t_back"))).alias("r_3"))
    return e.select(
        "src", "dst", "txn_id", "n2_1", "n2_2", "n3_1", (F.col("n2_2") * F.col("n2_1") - F.col("t")).alias("n3_2"), "n3_3",
        (F.col("onward") - F.col("r_1") - F.col("t") * (F.col("src_out") - 1) + F.col("t_to") - F.col("q")).alias("n4_1"),
        (F.col("n2_2") * F.col("n3_1") - F.col("t_out") + F.col("t_from") + F.col("t") - F.col("q")).alias("n4_2"),
        (F.col("n2_1") * F.col("n3_3") - F.col("t_in") + F.col("t_to") + F.col("t") - F.col("q")).alias("n4_3"),
        (F.col("inward") - F.col("r_3") - F.col("t") * (F.col("dst_in") - 1) + F.col("t_from") - F.col("q")).alias("n4_4"))


def chain_relation(counts: DataFrame, max_hops: int = 4) -> DataFrame:
    """(hop, src, dst, txn_id, paths): the simple paths of two to ``max_hops`` transfers that have the edge as their hop-th.

    The factorised form of all such paths: at most ``max_hops`` rows an edge, whatever the number of paths. ``counts``: ``path_counts``.
    """
    if not 2 <= max_hops <= 4:
        raise ValueError("max_hops must be 2, 3 or 4")
    total = lambda p: functools.reduce(lambda a, b: a + b, [F.col(f"n{n}_{p}") for n in range(max(2, p), max_hops + 1)])
    rows = counts.select("src", "dst", "txn_id", F.explode(F.array(*[
        F.struct(F.lit(p).alias("hop"), total(p).alias("paths")) for p in range(1, max_hops + 1)])).alias("h"))
    return rows.select("h.hop", "src", "dst", "txn_id", "h.paths").where("paths > 0")


def paths_from(edges: DataFrame, originators: DataFrame, max_hops: int = 4) -> DataFrame:
    """(originator, target, hops, chain, txn_ids): every simple path of two to ``max_hops`` transfers from the requested nodes.

    ``originators`` has a column ``node``. This lists paths, so its result grows with their number: ``path_counts`` tells it beforehand.
    """
    step = edges.select(F.col("src").alias("_last"), F.col("dst").alias("_next"), F.col("txn_id").alias("_txn"))
    paths = (edges.join(originators.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
             .select(F.array("src", "dst").alias("nodes"), F.array("txn_id").alias("txns")))
    listed = []
    for _ in range(2, max_hops + 1):
        paths = (paths.withColumn("_last", F.element_at("nodes", -1)).join(step, "_last").where(~F.array_contains("nodes", F.col("_next")))
                 .select(F.concat("nodes", F.array("_next")).alias("nodes"), F.concat("txns", F.array("_txn")).alias("txns")))
        paths = cut_lineage(paths)
        listed.append(paths)
    return functools.reduce(DataFrame.unionByName, listed).select(
        F.col("nodes")[0].alias("originator"), F.element_at("nodes", -1).alias("target"), F.size("txns").alias("hops"),
        F.array_join("nodes", "->").alias("chain"), F.array_join("txns", ",").alias("txn_ids"))
