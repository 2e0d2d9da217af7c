"""Interaction graph: build, rank, reach, bridges, segments, threads.

Edges run from the account that interacted to the original author. Iterative
algorithms are loops of joins and aggregates over tables written each round;
the driver sees counts and a few scalars only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.sequence import numbered, top_n_per_group
from driftlens.functions.time import time_bucket
from driftlens.operators.filters import POST_KEY
from driftlens.operators.grams import grouped
from driftlens.operators import paths
from driftlens.operators.timelines import with_emotions, with_topic
from driftlens.session import cut_lineage


def _account(side: str, by: str) -> Column:
    if by == "account_id":
        return F.col(f"{side}_account")
    if by == "platform_account":
        return F.concat_ws(":", F.col(f"{side}_platform"), F.col(f"{side}_account"))
    raise ValueError(f"unknown node key {by!r}")


def build_graph(edges: DataFrame, flagged: DataFrame | None = None, since=None, by: str = "account_id") -> DataFrame:
    """(src, dst, weight, kind, ts): parallel edges merged, weights summed, kind
    and time of the first. ``flagged`` drops accounts at both ends; unresolved
    ``post:`` targets never count. There is no edge cap."""
    d = edges.where(~F.col("dst_account").startswith("post:"))
    if since is not None:
        d = d.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    if flagged is not None:
        for side in ("src", "dst"):
            mark = flagged.select(F.col("platform").alias(f"{side}_platform"), F.col("account_id").alias(f"{side}_account")).distinct()
            d = d.join(mark, [f"{side}_platform", f"{side}_account"], "left_anti")
    return d.groupBy(_account("src", by).alias("src"), _account("dst", by).alias("dst")).agg(
        F.sum("weight").alias("weight"), F.min_by("kind", F.struct("ts", "kind")).alias("kind"), F.min("ts").alias("ts")
    )


def vertices(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("src").alias("account_id")).union(graph.select("dst")).distinct()


def undirected(graph: DataFrame) -> DataFrame:
    """(src, dst, weight), both directions present, reciprocal weights added."""
    both = graph.select("src", "dst", "weight").union(graph.select("dst", "src", "weight"))
    return both.where("src != dst").groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(graph: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """(account_id, pagerank), weighted; mass of accounts without outgoing edges
    is spread evenly. Stops when the total change is below n * tolerance; a
    tolerance of 0 asks for exactly ``rounds`` rounds. Raises when the rounds do
    not reach the tolerance.

    Edge shares are computed once and stay partitioned by source; each round is
    one join, one pre-combined aggregate and one scalar.
    """
    nodes = cut_lineage(vertices(graph), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("pagerank", F.lit(0.0))
    out = graph.groupBy("src").agg(F.sum("weight").alias("_total"))
    shares = cut_lineage(graph.join(out, "src").select("src", "dst", (F.col("weight") / F.col("_total")).alias("share")), "shares")
    base = nodes.join(out.select(F.col("src").alias("account_id"), F.lit(True).alias("_has_out")), "account_id", "left")
    ranks = cut_lineage(base.select("account_id", (F.col("_has_out").isNull()).alias("dangling"), F.lit(1.0 / n).alias("pagerank")), "ranks")
    for _ in range(rounds):
        lost = ranks.where("dangling").agg(F.sum("pagerank")).first()[0] or 0.0
        floor = (1.0 - damping) / n + damping * lost / n
        incoming = shares.join(ranks, shares["src"] == ranks["account_id"]).groupBy("dst").agg(
            F.sum(F.col("share") * F.col("pagerank")).alias("_in")
        )
        new = ranks.join(incoming, ranks["account_id"] == incoming["dst"], "left").select(
            "account_id", "dangling", F.col("pagerank").alias("_old"),
            (F.lit(floor) + damping * F.coalesce("_in", F.lit(0.0))).alias("pagerank"),
        )
        new = cut_lineage(new, "ranks")
        change = new.agg(F.sum(F.abs(F.col("pagerank") - F.col("_old")))).first()[0]
        ranks = new.drop("_old")
        if change < n * tolerance:
            break
    else:
        if tolerance > 0:
            raise RuntimeError("pagerank did not converge; raise rounds")
    return ranks.select("account_id", "pagerank")


PAIRS = 1 << 20  # of two hops, in a task


def two_hop_reach(graph: DataFrame, hub_degree: int = 10_000) -> DataFrame:
    """(account_id, reach): distinct accounts that interacted with an account,
    or with one of those, without itself.

    Pairs (account, reached) are made distinct before counting. A middle account
    with more than ``hub_degree`` interactors would multiply them, so hubs pass
    their interactors on as words of 64 accounts: never more rows than
    interactors, for a hub of most accounts 64 times fewer, OR-ed map-side.
    Both ways are exact. A task holds about PAIRS pairs, whatever their number.
    """
    ids = cut_lineage(vertices(graph).withColumn("id", F.monotonically_increasing_id()), "ids")
    e = graph.where("src != dst").select("src", "dst")
    e = e.join(ids.select(F.col("account_id").alias("src"), F.col("id").alias("who")), "src")
    e = e.join(ids.select(F.col("account_id").alias("dst"), F.col("id").alias("target")), "dst")
    e = cut_lineage(e.select("who", "target").distinct(), "hops")
    hubs = e.groupBy(F.col("target").alias("mid")).agg(F.count("*").alias("_d")).where(F.col("_d") > hub_degree).select("mid")
    hubs = cut_lineage(hubs, "hubs")
    into = e.select("who", F.col("target").alias("mid"))
    onward = e.select(F.col("who").alias("mid"), "target")
    # the pairs are many more than the edges that they come from: tasks are dealt by the pairs
    ends = into.groupBy("mid").agg(F.count("*").alias("_in")).where(F.col("_in") <= hub_degree).join(onward.groupBy("mid").agg(F.count("*").alias("_out")), "mid")
    tasks = int((ends.agg(F.sum(F.col("_in") * F.col("_out"))).first()[0] or 0) / PAIRS) + 1
    through = onward.join(hubs, "mid", "left_anti").repartition(tasks, "mid").join(into.repartition(tasks, "mid"), "mid").select("who", "target")
    pairs = e.union(through).where("who != target").repartition(tasks, "target", "who").distinct()
    if hubs.limit(1).count() == 0:
        counts = pairs.groupBy("target").agg(F.count("*").alias("reach"))
    else:
        served = onward.join(hubs, "mid", "left_semi").select("target").distinct()
        plain = pairs.join(served, "target", "left_anti").groupBy("target").agg(F.count("*").alias("reach"))
        word, bits = F.shiftright("who", 6).alias("word"), F.bit_or(F.expr("shiftleft(1L, cast(who & 63 as int))")).alias("m")
        hub_maps = cut_lineage(into.join(hubs, "mid", "left_semi").groupBy("mid", word).agg(bits), "maps")
        own_maps = pairs.join(served, "target", "left_semi").groupBy("target", word).agg(bits)
        passed = onward.join(hub_maps, "mid").select("target", "word", "m")
        union = own_maps.unionByName(passed).groupBy("target", "word").agg(F.bit_or("m").alias("m"))
        sizes = union.groupBy("target").agg(F.sum(F.bit_count("m")).alias("n"))
        # the account itself is in the map when it interacted with a hub that it is also an onward target of
        loops = into.join(hubs, "mid", "left_semi").select(F.col("who").alias("target"), "mid").join(
            onward, ["mid", "target"], "left_semi"
        ).select("target").distinct().withColumn("_loop", F.lit(1))
        mapped = sizes.join(loops, "target", "left").select("target", (F.col("n") - F.coalesce("_loop", F.lit(0))).alias("reach"))
        counts = plain.unionByName(mapped)
    return ids.join(counts, ids["id"] == counts["target"], "left").select(
        "account_id", F.coalesce("reach", F.lit(0)).cast("bigint").alias("reach")
    )


def interactors(graph: DataFrame, account_id: str) -> DataFrame:
    """Accounts within two hops of one account: first hop UNION second hop."""
    e = graph.select(F.col("src").alias("who"), "dst")
    first = e.where(F.col("dst") == account_id).select("who").distinct()
    second = e.join(first.select(F.col("who").alias("dst")), "dst").select("who")
    return first.union(second).distinct().where(F.col("who") != account_id).select(F.col("who").alias("account_id"))


def sampled_betweenness(graph: DataFrame, pivots: int = 200, seed: int = 7, directed: bool = True, room: int | None = None) -> DataFrame:
    """(account_id, betweenness) from shortest paths of ``pivots`` sources.

    Up to ``room`` edges a task holds them all (``paths.dependencies``). With more,
    breadth-first levels are joins on a (pivot, node) frame; dependencies flow
    back level by level. Paths are unweighted. Pivots are the accounts with the
    smallest hash of (id, seed), so a rerun picks the same ones; scores are
    scaled by n / pivots and by (n - 1)(n - 2).
    """
    e = graph if directed else undirected(graph)
    e = cut_lineage(e.select("src", "dst").where("src != dst").distinct(), "bfs_edges")
    nodes = cut_lineage(vertices(graph), "nodes")
    n = nodes.count()
    if n < 3:
        return nodes.withColumn("betweenness", F.lit(0.0))
    k = min(pivots, n)
    chosen = nodes.orderBy(F.xxhash64("account_id", F.lit(seed)), "account_id").limit(k)
    scale = 1.0 / ((n - 1) * (n - 2)) * (n / k)
    if max(n, e.count()) <= (paths.ROOM if room is None else room):
        sums = paths.dependencies(nodes, e, chosen, False).select("account_id", (F.col("delta") * scale).alias("betweenness"))
        return nodes.join(sums, "account_id", "left").fillna(0.0, ["betweenness"])
    frontier = cut_lineage(chosen.select(F.col("account_id").alias("pivot"), F.col("account_id").alias("node"),
                                         F.lit(1.0).alias("paths")), "level")
    levels = [frontier]
    seen = frontier.select("pivot", "node")
    while True:
        step = frontier.join(e, frontier["node"] == e["src"]).groupBy("pivot", F.col("dst").alias("node")).agg(
            F.sum("paths").alias("paths")
        )
        frontier = cut_lineage(step.join(seen, ["pivot", "node"], "left_anti"), "level")
        if frontier.limit(1).count() == 0:
            break
        levels.append(frontier)
        seen = seen.union(frontier.select("pivot", "node"))
    total = None
    delta = levels[-1].select("pivot", "node", F.lit(0.0).alias("delta"), "paths")
    for depth in range(len(levels) - 1, 0, -1):
        mine = delta.where(F.col("pivot") != F.col("node")).select("node", "delta")
        total = mine if total is None else total.unionByName(mine)
        upper = levels[depth - 1]
        flow = (
            delta.select("pivot", F.col("node").alias("dst"), ((1.0 + F.col("delta")) / F.col("paths")).alias("c"))
            .join(e, "dst").join(upper.select("pivot", F.col("node").alias("src"), "paths"), ["pivot", "src"])
            .groupBy("pivot", F.col("src").alias("node")).agg(F.sum(F.col("paths") * F.col("c")).alias("delta"))
        )
        delta = cut_lineage(
            upper.join(flow, ["pivot", "node"], "left").select("pivot", "node", F.coalesce("delta", F.lit(0.0)).alias("delta"), "paths"),
            "delta",
        )
    if total is None:
        return nodes.withColumn("betweenness", F.lit(0.0))
    sums = total.groupBy(F.col("node").alias("account_id")).agg((F.sum("delta") * scale).alias("betweenness"))
    return nodes.join(sums, "account_id", "left").fillna(0.0, ["betweenness"])


def influence(graph: DataFrame, reach: DataFrame, rank: DataFrame, betweenness: DataFrame,
              weights: dict[str, float] | None = None) -> DataFrame:
    """(account_id, influence, pagerank, betweenness, reach, role): each part
    divided by its maximum, then weighted."""
    weights = fixed.INFLUENCE_WEIGHTS if weights is None else weights
    degree = graph.groupBy(F.col("src").alias("account_id")).agg(F.countDistinct("dst").alias("_out"))
    d = reach.join(rank, "account_id").join(betweenness, "account_id").join(degree, "account_id", "left")
    top = d.agg(*[F.max(c).alias(c) for c in weights]).first()
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + w * F.col(c) / F.lit(float(top[c] or 1.0))
    role = F.when(F.col("reach") > F.coalesce("_out", F.lit(0)), "originator").otherwise("amplifier")
    return d.select("account_id", score.alias("influence"), "pagerank", "betweenness", "reach", role.alias("role"))


def top_influencers(scored: DataFrame, top_n: int = 20) -> DataFrame:
    return scored.orderBy(F.desc("influence"), "account_id").limit(top_n)


def ranked(scored: DataFrame, depth: int = 500) -> DataFrame:
    """(account_id, rank) of the first ``depth`` accounts: a bounded set, so the
    numbering window runs over at most ``depth`` rows."""

    top = top_influencers(scored, depth)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("influence"), "account_id")))


def rank_in_other_view(raw: DataFrame, organic: DataFrame, depth: int = 500) -> DataFrame:
    """(account_id, rank_raw, rank_organic), NULL where outside a view's depth."""
    a = ranked(raw, depth).select("account_id", F.col("rank").alias("rank_raw"))
    b = ranked(organic, depth).select("account_id", F.col("rank").alias("rank_organic"))
    return a.join(b, "account_id", "full")


WHOLE = 1 << 24  # links of a graph that one task holds: 8 bytes a link as rows, some 40 while they are sorted


def communities(graph: DataFrame, resolution: float = 1.0, max_rounds: int = 1000, stats: list | None = None, room: int | None = None) -> DataFrame:
    """(account_id, community) by modularity: local moving, then aggregation.

    A pass moves nodes to the neighbouring community of the best positive gain until
    no node has one (``room`` links to a task); its communities become the nodes of a smaller graph for the next
    pass, until a pass merges nothing. Passes over at most ``WHOLE`` links (or ``room``) go through one
    task, of numbers only; larger ones by rounds. The label is the smallest member. ``stats`` receives
    the number of moves of each round, a list for each pass.
    """
    links = cut_lineage(undirected(graph), "links")
    two_m = links.agg(F.sum("weight")).first()[0]
    member = vertices(graph).select("account_id", F.col("account_id").alias("node"))
    loops = None
    while two_m and links.limit(1).count():
        last = links.count() <= (WHOLE if room is None else room)
        if last:
            label, passes = _all_passes(links, loops, two_m, resolution)
        else:
            label, moves = _local_moving(links, loops, two_m, resolution, max_rounds, room)
            passes = [moves]
        if stats is not None:
            stats.extend(passes)
        before, after = label.agg(F.count("*"), F.countDistinct("community")).first()
        if after == before:
            break
        member = cut_lineage(
            member.join(label, "node", "left").select("account_id", F.coalesce("community", "node").alias("node")), "member"
        )
        if last:
            break
        a = label.select(F.col("node").alias("src"), F.col("community").alias("c_src"))
        b = label.select(F.col("node").alias("dst"), F.col("community").alias("c_dst"))
        merged = cut_lineage(
            links.join(a, "src").join(b, "dst").groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("weight").alias("weight")),
            "merged",
        )
        inner = merged.where("src = dst").select(F.col("src").alias("node"), F.col("weight").alias("loop"))
        if loops is not None:
            old = loops.join(label, "node").select(F.col("community").alias("node"), "loop")
            inner = inner.unionByName(old).groupBy("node").agg(F.sum("loop").alias("loop"))
        loops = cut_lineage(inner, "loops")
        links = merged.where("src != dst")
    smallest = member.groupBy("node").agg(F.min("account_id").alias("community"))
    return member.join(smallest, "node").select("account_id", "community")


def _all_passes(links: DataFrame, loops: DataFrame | None, two_m: float, resolution: float) -> tuple[DataFrame, list[list[int]]]:
    """(node, community) after all passes over ``links``, and the moves of each pass. One
    task holds a row of two numbers and a weight for each two linked nodes."""
    ids = numbered(links.select(F.col("src").alias("node")).distinct(), ["node"], "id").select("node", F.col("id").cast("int").alias("id"))
    n = ids.count()
    one, two = (ids.select(F.col("node").alias(c), F.col("id").alias(x)) for c, x in (("src", "a"), ("dst", "b")))
    d = links.where("src < dst").join(one, "src").join(two, "dst").select("a", "b", "weight")
    pairs = links.where("src < dst").count()
    if loops is not None:
        d = d.unionByName(loops.join(ids, "node").select(F.col("id").alias("a"), F.lit(-1).alias("b"), F.col("loop").alias("weight")))

    def run(batches):
        a, b, weight, loop, at = np.empty(pairs, np.int32), np.empty(pairs, np.int32), np.empty(pairs), np.zeros(n), 0
        for batch in batches:
            one, two, w = (batch.column(c).to_numpy() for c in ("a", "b", "weight"))
            inner = two < 0
            loop[one[inner]] = w[inner]
            rows = slice(at, at + int((~inner).sum()))
            a[rows], b[rows], weight[rows] = one[~inner], two[~inner], w[~inner]
            at = rows.stop
        order = np.argsort((a.astype(np.int64) << 32) | b)
        label, moves = _in_passes(a[order], b[order], weight[order], loop, resolution / two_m)
        # the moves of a pass stand at a number below 0
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([np.arange(n), -1 - np.arange(len(moves))]), pa.int32()), pa.array(np.concatenate([label, moves]), pa.int32()),
        ], ["id", "to"])

    found = cut_lineage(d.repartition(1).mapInArrow(run, "id int, to int"), "passes")
    moves = [[r["to"]] for r in found.where("id < 0").orderBy(F.desc("id")).collect()]
    named = found.where("id >= 0").join(ids, "id").select("node", F.col("to").alias("id")).join(ids.withColumnRenamed("node", "community"), "id")
    return cut_lineage(named.select("node", "community"), "label"), moves


def _in_passes(a: np.ndarray, b: np.ndarray, weight: np.ndarray, loop: np.ndarray, scale: float) -> tuple[np.ndarray, list[int]]:
    """(the community of each node by its smallest member, moves of each pass); a link stands once."""
    n = len(loop)
    where, moves = np.arange(n), []
    while len(a):
        size = len(loop)
        degree = loop + np.bincount(a, weight, size) + np.bincount(b, weight, size)
        begin = np.concatenate([a, b])
        order = np.argsort(begin, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(begin, minlength=size))])
        del begin
        ref, w = np.concatenate([b, a])[order], np.concatenate([weight, weight])[order]
        del order
        label = np.arange(2 * size)
        _move(ref, w, bounds, label, degree, degree.copy(), np.flatnonzero(np.diff(bounds)), scale)
        del ref, w
        moves.append(int((label[:size] != np.arange(size)).sum()))
        names, own = np.unique(label[:size], return_inverse=True)
        if len(names) == size:
            break
        where = own[where]
        a, b = own[a], own[b]
        inner = a == b
        loop = np.bincount(own, loop, len(names)) + 2 * np.bincount(a[inner], weight[inner], len(names))
        key = (np.minimum(a, b)[~inner] << 32) | np.maximum(a, b)[~inner]
        key, place = np.unique(key, return_inverse=True)
        weight = np.bincount(place, weight[~inner], len(key))
        a, b = (key >> 32).astype(np.int32), (key & 0x7FFFFFFF).astype(np.int32)
    return np.unique(where, return_index=True)[1][where], moves


ROOM = 1 << 21  # links that a task settles


def _local_moving(links: DataFrame, loops: DataFrame | None, two_m: float, resolution: float, max_rounds: int, room: int | None = None) -> tuple[DataFrame, list[int]]:
    """(node, community) from which no node has a move of positive gain, and the
    moves of each round.

    A move inside a set of communities changes no gain of a move inside another set, so
    the communities are dealt into sets anew in each round, and a task moves the nodes of its
    set until none gains. Each move raises modularity. Sets
    are so many that a task holds about ``room`` links. Only nodes with a wish may move; links
    to the others are summed by community. The rounds
    end when no node of the whole graph has a wish.
    """
    room = ROOM if room is None else room
    degree = links.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
    if loops is not None:
        degree = degree.join(loops, "node", "left").select("node", (F.col("k") + F.coalesce("loop", F.lit(0.0))).alias("k"))
    label = cut_lineage(degree.select("node", "k", F.col("node").alias("community")), "label")
    moves: list[int] = []
    for r in range(max_rounds):
        wish = cut_lineage(_wishes(links, label, two_m, resolution), "wish")
        if wish.isEmpty():
            return label.select("node", "community"), moves
        granted = cut_lineage(_settled_sets(links, label, wish, two_m, resolution, room, r), "granted")
        moves.append(granted.count())
        new = label.join(granted, "node", "left").select("node", "k", F.coalesce("to", "community").alias("community"))
        label = cut_lineage(new, "label")
    raise RuntimeError("communities did not settle; raise max_rounds")


def _wishes(links: DataFrame, label: DataFrame, two_m: float, resolution: float) -> DataFrame:
    """(node) of each node that gains by a move."""
    total = label.groupBy("community").agg(F.sum("k").alias("tot"))
    toward = links.join(label.select(F.col("node").alias("dst"), "community"), "dst").groupBy(F.col("src").alias("node"), "community").agg(F.sum("weight").alias("w"))
    # a node without links into its own community may leave it too
    toward = toward.unionByName(label.select("node", "community", F.lit(0.0).alias("w")))
    toward = toward.join(total, "community").join(label.select("node", "k", F.col("community").alias("own")), "node")
    mine = F.col("community") == F.col("own")
    rest = F.col("tot") - F.when(mine, F.col("k")).otherwise(0.0)
    gain = toward.withColumn("g", F.round(F.col("w") - resolution * F.col("k") * rest / F.lit(two_m), 9))
    # of the two rows of its own community the one without weight is never the larger
    best = gain.groupBy("node").agg(F.max(F.when(mine, F.col("g"))).alias("g0"), F.max(F.when(~mine, F.col("g"))).alias("g"))
    return best.where(F.col("g") > F.greatest("g0", F.lit(0.0)) + GAIN).select("node")


GAIN = 1e-9  # gains up to this are rounding


def _settled_sets(links: DataFrame, label: DataFrame, wish: DataFrame, two_m: float, resolution: float, room: int, r: int) -> DataFrame:
    """(node, to) of the nodes that move in a round."""
    total = label.groupBy("community").agg(F.sum("k").alias("tot"))
    at = label.join(total, "community").join(wish.withColumn("may", F.lit(True)), "node", "left")
    at = cut_lineage(at.withColumn("may", F.coalesce("may", F.lit(False))), "at")
    own = at.where("may").select(F.col("node").alias("src"), "k", F.col("community").alias("own"), F.col("tot").alias("own_tot"))
    other = at.select(F.col("node").alias("dst"), F.col("community").alias("c"), "tot", "may")
    d = links.join(own, "src").join(other, "dst").select("src", F.when(F.col("may"), F.col("dst")).alias("dst"), "own", "c", "k", "own_tot", "tot", "weight")
    d = cut_lineage(d.groupBy("src", "dst", "own", "c", "k", "own_tot", "tot").agg(F.sum("weight").alias("weight")), "moving")
    inside, across = d.agg(F.count_if(F.col("own") == F.col("c")), F.count_if(F.col("own") != F.col("c"))).first()
    sets = 1
    while sets < MAX_SETS and inside / sets + across / sets**2 > room:
        sets += 1
    lot = [F.pmod(F.xxhash64(F.col(x), F.lit(r)), F.lit(sets)) for x in ("own", "c")]
    d = d.withColumn("lot", lot[0]).where(lot[0] == lot[1])
    if inside / sets + across / sets**2 > room:
        # few large communities: some of their nodes wait for the next round
        share = int(1000 * room / (inside / sets + across / sets**2)) + 1
        d = d.where(F.pmod(F.xxhash64("src", F.lit(r)), F.lit(1000)) < share)
        drawn = F.pmod(F.xxhash64("dst", F.lit(r)), F.lit(1000)) < share
        d = d.withColumn("dst", F.when(drawn, F.col("dst")))
    d = d.select("lot", "src", "dst", "own", "c", "k", "own_tot", "tot", "weight")
    return d.repartition(sets, "lot").sortWithinPartitions("lot").mapInArrow(_settle(two_m, resolution), "node string, to string")


MAX_SETS = 4096


def _settle(two_m: float, resolution: float):
    """(node, to): local moving of the nodes ``src`` of a set, one after the other, over
    links to each other (``dst``) and to nodes that stay (no ``dst``)."""
    def run(batches):
        for _, table in grouped(batches, 1):
            names = np.unique(np.concatenate([pc.unique(table[c]).drop_null().to_numpy(zero_copy_only=False) for c in ("src", "own", "c")]))
            n = len(names)
            known = pa.array(names, table.schema.field("src").type)
            src, own, com = (pc.index_in(table[c], known).to_numpy() for c in ("src", "own", "c"))
            dst = pc.fill_null(pc.index_in(table["dst"], known), -1).to_numpy()
            k, tot, own_tot, weight = (table[c].to_numpy() for c in ("k", "tot", "own_tot", "weight"))
            total, degree, label = np.zeros(n), np.zeros(n), np.arange(2 * n)
            total[com], total[own] = tot, own_tot
            degree[src], label[src], label[n:] = k, own, np.arange(n)
            order = np.lexsort((weight, com, dst, src))
            # a link to a node that stays is one to its community
            ref, weight = np.where(dst < 0, n + com, dst)[order], weight[order]
            bounds = np.searchsorted(src[order], np.arange(n + 1))
            start = label[:n].copy()
            _move(ref, weight, bounds, label, degree, total, np.unique(src), resolution / two_m)
            moved = np.flatnonzero(label[:n] != start)
            yield pa.RecordBatch.from_arrays([pa.array(names[moved], pa.string()), pa.array(names[label[moved]], pa.string())], ["node", "to"])

    return run


def _move(ref: np.ndarray, weight: np.ndarray, bounds: np.ndarray, label: np.ndarray, degree: np.ndarray, total: np.ndarray, movers: np.ndarray, scale: float) -> None:
    """Moves ``movers`` in ``label``: nodes next to one that moved are looked at again, all when
    none of those gains.

    Nodes are looked at in parts, so small that few of a part are linked to each other. Of two linked
    ones that gain the later waits, so the links of the others stand, and each moves only if it
    still gains by the totals that the moves before it leave.
    """
    movers = movers[bounds[movers + 1] > bounds[movers]]
    if not len(movers):
        return
    rng, n = np.random.default_rng(len(movers)), len(total)
    links = (bounds[movers + 1] - bounds[movers]).sum()
    size = max(1, int(len(movers) ** 2 / (4 * links)))
    waits, rank, moving = np.zeros(n, bool), np.full(len(label), len(label)), True
    while moving:
        moving = False
        waits[movers] = True
        while waits.any():
            turn = rng.permutation(np.flatnonzero(waits))
            for start in range(0, len(turn), size):
                part = turn[start : start + size]
                waits[part] = False
                owner, near, again, moved = _moved(part, ref, weight, bounds, label, degree, total, scale, rank)
                waits[again] = True
                if moved.any():
                    moving = True
                    beside = moved[owner]
                    near, to = near[beside], label[part][owner[beside]]
                    there = near < n
                    near, to = near[there], to[there]
                    near = near[label[near] != to]
                    waits[near[bounds[near + 1] > bounds[near]]] = True


def _moved(part: np.ndarray, ref: np.ndarray, weight: np.ndarray, bounds: np.ndarray, label: np.ndarray, degree: np.ndarray, total: np.ndarray, scale: float, rank: np.ndarray):
    """Moves those of ``part`` that gain: (the place in the part and the other end of each link, the
    nodes that wait, whether a node moved)."""
    first, n = bounds[part], len(total)
    many = bounds[part + 1] - first
    owner = np.repeat(np.arange(len(part)), many)
    edge = np.arange(len(owner)) + np.repeat(first - (np.cumsum(many) - many), many)
    near = ref[edge]
    key = owner * n + label[near]
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sums = np.add.reduceat(weight[edge[order]], heads)
    who, com = np.divmod(key[heads], n)
    k, at = degree[part], label[part]
    home = com == at[who]
    gain = np.round(sums - scale * k[who] * (total[com] - np.where(home, k[who], 0.0)), 9)
    own = np.zeros(len(part))
    own[who[home]] = sums[home]
    stay = np.maximum(np.round(own - scale * k * (total[at] - k), 9), 0.0)
    gain[home] = -np.inf
    best = np.maximum.reduceat(gain, np.searchsorted(who, np.arange(len(part))))
    top = np.flatnonzero(gain == best[who])
    top = top[np.unique(who[top], return_index=True)[1]]
    gains = best > stay + GAIN
    moved, wish = np.zeros(len(part), bool), np.flatnonzero(gains)
    rank[part[wish]] = wish
    theirs = gains[owner]
    later = owner[theirs][rank[near[theirs]] < owner[theirs]]
    rank[part[wish]] = len(rank)
    gains[later] = False
    again = part[np.unique(later)]
    now = np.flatnonzero(gains)
    rows = (now, part[now], at[now], com[top[now]], sums[top[now]], own[now], k[now])
    for i, u, a, c, w, w0, ku in zip(*(x.tolist() for x in rows), strict=True):
        if round(w - scale * ku * total[c], 9) > max(round(w0 - scale * ku * (total[a] - ku), 9), 0.0) + GAIN:
            total[a] -= ku
            total[c] += ku
            label[u] = c
            moved[i] = True
    return owner, near, again, moved


def bridge_accounts(graph: DataFrame, community: DataFrame, betweenness: DataFrame, top_n: int = 10) -> DataFrame:
    """Accounts touching more than one community (their own included), highest
    betweenness first."""
    links = undirected(graph).select("src", "dst")
    near = links.join(community.select(F.col("account_id").alias("dst"), F.col("community").alias("c")), "dst").select(
        F.col("src").alias("account_id"), "c"
    )
    own = community.select("account_id", F.col("community").alias("c"))
    touched = near.union(own).groupBy("account_id").agg(F.countDistinct("c").alias("communities_touched"))
    return touched.where(F.col("communities_touched") > 1).join(betweenness, "account_id").orderBy(
        F.desc("betweenness"), "account_id"
    ).limit(top_n).select("account_id", "betweenness", "communities_touched")


def weighted_degree(graph: DataFrame) -> DataFrame:
    ends = graph.select(F.col("src").alias("account_id"), "weight").union(graph.select("dst", "weight"))
    return ends.groupBy("account_id").agg(F.sum("weight").alias("degree"))


def top_degree_subgraph(graph: DataFrame, max_nodes: int = 250) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, edges among them) of the heaviest accounts."""
    top = weighted_degree(graph).orderBy(F.desc("degree"), "account_id").limit(max_nodes)
    keep = cut_lineage(top, "top")
    edges = graph.join(keep.select(F.col("account_id").alias("src")), "src", "left_semi").join(
        keep.select(F.col("account_id").alias("dst")), "dst", "left_semi"
    )
    return keep, edges


def home_platform(posts: DataFrame) -> DataFrame:
    """(account_id, platform) the account posts on most; ties to the smaller name."""
    counts = posts.groupBy(F.col("author_id").alias("account_id"), "platform").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("platform").alias("platform"))).alias("b")
    return counts.groupBy("account_id").agg(best).select("account_id", "b.platform")


def graph_payload(graph: DataFrame, coord_accounts: DataFrame, behaviour: DataFrame, posts: DataFrame,
                  accounts: DataFrame, max_nodes: int = 250) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a network view. Attributes are looked up for the kept
    accounts only."""
    nodes, edges = top_degree_subgraph(graph, max_nodes)
    ids = nodes.select("account_id")
    edges = cut_lineage(edges, "subgraph")
    best = coord_accounts.join(ids, "account_id", "left_semi").groupBy("account_id").agg(F.max("score").alias("coord_score"))
    acts = behaviour.join(ids, "account_id", "left_semi").groupBy("account_id").agg(F.max("likelihood").alias("behaviour_likelihood"))
    who = accounts.join(ids, "account_id", "left_semi").groupBy("account_id").agg(
        F.max("followers").alias("followers"), F.max("handle").alias("handle")
    )
    mine = posts.select("author_id", "platform").join(ids.withColumnRenamed("account_id", "author_id"), "author_id", "left_semi")
    d = nodes
    for part in (communities(edges), pagerank(edges), best, acts, home_platform(mine), who):
        d = d.join(part, "account_id", "left")
    out = d.select(
        "account_id", F.round("degree", 2).alias("degree"), F.coalesce("community", "account_id").alias("community"),
        F.round(F.coalesce("pagerank", F.lit(0.0)), 5).alias("pagerank"),
        F.round(F.coalesce("coord_score", F.lit(0.0)), 3).alias("coord_score"),
        (F.coalesce("coord_score", F.lit(0.0)) >= fixed.COORDINATED_SCORE).alias("coordinated"),
        F.round(F.coalesce("behaviour_likelihood", F.lit(0.0)), 3).alias("behaviour_likelihood"),
        F.coalesce("platform", F.lit("unknown")).alias("platform"), "followers",
        F.coalesce("handle", "account_id").alias("handle"),
    )
    return out, edges.select("src", "dst", F.round("weight", 2).alias("weight"), "kind", "ts")


def influence_views(edges: DataFrame, flagged: DataFrame, coord_accounts: DataFrame, accounts: DataFrame, *,
                    top_n: int = 50, depth: int = 500, pivots: int = 200, bridge_pivots: int = 300,
                    bridges: int = 8) -> dict[str, DataFrame]:
    """Influencer and bridge rankings for all accounts and for organic ones.
    Influencers are ranked by paths whose length is the sum of weights, bridges by
    their number of edges."""
    graphs = {"raw": build_graph(edges), "organic": build_graph(edges, flagged)}
    scored, bridge_frames = {}, []
    for view, g in graphs.items():
        g = cut_lineage(g, "graph")
        scored[view] = cut_lineage(
            influence(g, two_hop_reach(g), pagerank(g), paths.weighted_betweenness(g, pivots)), "influence"
        )
        central = sampled_betweenness(g, bridge_pivots, directed=False)
        b = bridge_accounts(g, communities(g), central, bridges)
        bridge_frames.append(b.withColumn("view", F.lit(view)))
    ranks = {v: ranked(scored[v], max(top_n, depth)).select("account_id", F.col("rank")) for v in graphs}
    best = coord_accounts.groupBy("account_id").agg(F.max("score").alias("coord_score"))
    names = accounts.groupBy("account_id").agg(F.max("handle").alias("handle"))
    frames = []
    for view, other in (("raw", "organic"), ("organic", "raw")):
        top = scored[view].join(ranks[view].where(F.col("rank") <= top_n), "account_id")
        frames.append(top.join(ranks[other].withColumnRenamed("rank", "rank_other_view"), "account_id", "left").withColumn("view", F.lit(view)))
    people = frames[0].unionByName(frames[1]).join(best, "account_id", "left").join(names, "account_id", "left")
    people = people.withColumns({
        "coord_score": F.coalesce("coord_score", F.lit(0.0)), "handle": F.coalesce("handle", "account_id"),
    }).withColumn("coordinated", F.col("coord_score") >= fixed.COORDINATED_SCORE)
    links = bridge_frames[0].unionByName(bridge_frames[1]).join(names, "account_id", "left").withColumn(
        "handle", F.coalesce("handle", "account_id")
    )
    return {"influencers": people, "bridges": links}


def audience_segments(graph: DataFrame, flagged: DataFrame, posts: DataFrame, assign: DataFrame, topics: DataFrame,
                      top_k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(account_segments, segment_labels): segment 0 is the flagged group, then
    the largest communities of the rest; others are -1.

    A label is the topic the segment talks about most that no larger segment
    took, plus its main platform. Only ``top_k`` candidate topics per segment
    reach the driver: a segment can lose at most top_k - 1 of them.
    """
    coord = flagged.select("account_id").distinct()
    rest = graph
    for side in ("src", "dst"):
        rest = rest.join(coord.withColumnRenamed("account_id", side), side, "left_anti")
    lone = vertices(graph).join(coord, "account_id", "left_anti")
    comm = lone.join(communities(cut_lineage(rest, "rest")), "account_id", "left").select(
        "account_id", F.coalesce("community", "account_id").alias("community")
    )
    comm = cut_lineage(comm, "communities")
    largest = comm.groupBy("community").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "community").limit(top_k)
    order = {r["community"]: (i + 1, r["size"]) for i, r in enumerate(largest.collect())}
    pick = F.lit(-1)
    for c, (i, _) in order.items():
        pick = F.when(F.col("community") == c, i).otherwise(pick)
    segments = comm.select("account_id", pick.cast("int").alias("segment")).unionByName(
        coord.select("account_id", F.lit(0).alias("segment"))
    )
    segments = cut_lineage(segments, "segments")
    named = segments.where("segment > 0")
    talk = (
        with_topic(posts, assign).select(F.col("author_id").alias("account_id"), "topic_id")
        .join(named, "account_id").groupBy("segment", "topic_id").agg(F.count("*").alias("n"))
        .join(topics.where(F.col("nature") != "manufactured").select("topic_id", "label"), "topic_id")
    )
    candidates = top_n_per_group(talk, ["segment"], [F.desc("n"), F.col("topic_id")], max(top_k, 1)).orderBy("segment", "rank").collect()
    where = home_platform(posts).join(named, "account_id").groupBy("segment", "platform").agg(F.count("*").alias("n"))
    main = {r["segment"]: r["platform"] for r in top_n_per_group(where, ["segment"], [F.desc("n"), F.col("platform")], 1).collect()}
    labels, used = [], set()
    flagged_size = coord.count()
    if flagged_size:
        labels.append((0, "Coordinated group", flagged_size))
    for _, (i, size) in sorted(order.items(), key=lambda kv: kv[1][0]):
        plat = fixed.SEGMENT_PLATFORM_NAMES.get(main.get(i), main.get(i) or "mixed")
        topic = next((r["label"] for r in candidates if r["segment"] == i and r["label"] not in used), None)
        if topic:
            used.add(topic)
            labels.append((i, f"“{topic}” crowd · {plat}", size))
        else:
            labels.append((i, f"Community {'ABCDEFGH'[(i - 1) % 8]} · {plat}", size))
    return segments, graph.sparkSession.createDataFrame(labels, "segment INT, label STRING, size BIGINT")


def segment_spread(posts: DataFrame, assign: DataFrame, segments: DataFrame, emotions: DataFrame,
                   topic_id: int, labelled: list[int]) -> tuple[DataFrame, DataFrame]:
    """(frames, summary) of one topic: posts per bucket and segment, first post
    and mean anxiety per segment. Topics shorter than 12 hours get 10-minute
    buckets. A post whose anxiety is unknown counts as 0 in the mean."""
    d = with_topic(posts, assign.where(F.col("topic_id") == topic_id))
    lo, hi = d.agg(F.min("created_at"), F.max("created_at")).first()
    width = "10m" if lo is not None and (hi - lo).total_seconds() < 12 * 3600 else "1h"
    marks = segments.select(F.col("account_id").alias("author_id"), "segment")
    key = F.when(F.col("segment").isin(labelled), F.concat(F.lit("s"), F.col("segment").cast("string"))).otherwise("other")
    d = with_emotions(d.join(marks, "author_id", "left"), emotions).withColumn("key", key).withColumn(
        "bucket", time_bucket(F.col("created_at"), width)
    )
    cells = d.groupBy("bucket", F.coalesce("segment", F.lit(-1)).alias("segment"), "key").agg(
        F.count("*").alias("n"), F.avg("anxiety").alias("a"), F.min("created_at").alias("first")
    )
    keys = [f"s{i}" for i in labelled] + ["other"]
    frames = cells.groupBy("bucket").pivot("key", keys).agg(F.sum("n")).fillna(0, keys)
    summary = cells.groupBy("key").agg(
        F.min("first").alias("first_seen"), F.sum("n").alias("posts"),
        F.round(F.sum(F.coalesce("a", F.lit(0.0)) * F.col("n")) / F.sum("n"), 3).alias("anxiety"),
    )
    return frames, summary


def account_detail(account_id: str, posts: DataFrame, accounts: DataFrame, edges: DataFrame, assign: DataFrame,
                   topics: DataFrame, coord_accounts: DataFrame, segments: DataFrame | None = None,
                   labels: DataFrame | None = None) -> dict[str, DataFrame]:
    """Public profile, activity and ties of one account. Nothing inferred about
    the person appears here."""
    mine = posts.where(F.col("author_id") == account_id)
    out = edges.where((F.col("src_account") == account_id) & ~F.col("dst_account").startswith("post:"))
    inward = edges.where(F.col("dst_account") == account_id)
    handles = accounts.groupBy("account_id").agg(F.max("handle").alias("handle"))

    def ties(d: DataFrame, side: str) -> DataFrame:
        grouped = d.groupBy(F.col(f"{side}_account").alias("account_id"), F.col(f"{side}_platform").alias("platform"), "kind").agg(
            F.count("*").alias("n"), F.min("ts").alias("first")
        )
        return grouped.orderBy(F.desc("n"), "account_id", "platform", "kind").limit(12).join(handles, "account_id", "left")

    result = {
        "profile": accounts.where(F.col("account_id") == account_id).orderBy(F.desc_nulls_last("followers"), "platform").limit(1).select(
            "platform", "handle", "display_name", "followers", "following", "created_at", "verified"
        ),
        "platforms": mine.groupBy("platform").agg(
            F.count("*").alias("n"), F.min("created_at").alias("first"), F.max("created_at").alias("last"),
            F.count_if(F.col("kind").isin(fixed.COMMENT_KINDS)).alias("comments"),
        ),
        "topics": with_topic(mine, assign).groupBy("topic_id").agg(F.count("*").alias("n")).join(
            topics.select("topic_id", "label", "nature"), "topic_id"
        ).orderBy(F.desc("n"), "topic_id").limit(4),
        "coordination": coord_accounts.where(F.col("account_id") == account_id).agg(F.round(F.max("score"), 3).alias("coord_score")),
        "degree": inward.select(F.col("src_account").alias("in_id"), F.lit(None).cast("string").alias("out_id")).union(
            out.select(F.lit(None).cast("string"), "dst_account")
        ).agg(F.countDistinct("in_id").alias("engaged_by"), F.countDistinct("out_id").alias("engages_with")),
        "in_ties": ties(inward, "src"),
        "out_ties": ties(out, "dst"),
    }
    if segments is not None and labels is not None:
        result["segment"] = segments.where(F.col("account_id") == account_id).join(labels, "segment").select("segment", "label")
    return result


def thread(posts: DataFrame, platform: str, post_id: str) -> DataFrame:
    """Posts reachable from a root over reply and repost links, with ``depth``.

    One frontier join per level; a level is written before the next, and each
    post keeps the first depth it was reached at.
    """
    links = posts.select("post_id", F.explode(F.array_distinct(F.filter(
        F.array("parent_post_id", "origin_post_id"), lambda x: x.isNotNull()))).alias("up")).select(F.col("post_id").alias("child"), "up")
    root = posts.where((F.col("platform") == platform) & (F.col("post_id") == post_id)).select("post_id").distinct()
    frontier = cut_lineage(root.withColumn("depth", F.lit(0)), "thread")
    reached = frontier
    depth = 0
    while True:
        depth += 1
        step = links.join(frontier.select(F.col("post_id").alias("up")), "up").select(F.col("child").alias("post_id")).distinct()
        frontier = cut_lineage(
            step.join(reached.select("post_id"), "post_id", "left_anti").withColumn("depth", F.lit(depth)), "thread"
        )
        if frontier.limit(1).count() == 0:
            break
        reached = reached.unionByName(frontier)
    return posts.join(reached, "post_id").where((F.col("depth") > 0) | (F.col("platform") == platform))
