"""Communities of a weighted graph by modularity: local moves, then contraction to a coarser graph, level by level.

Tables: links (a, b, weight), undirected, each pair once with a < b or a = b; members (node, community).

The modularity of a partition is the sum over communities of inside / m - (degree / 2m)^2, with m the links' whole
weight, inside a community's and degree the summed degrees of its nodes (a link to oneself counts twice).
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Rounds of moves without a gain after which a level is done.
IDLE = 3

#: Links of a level at most that the driver takes to move its nodes one by one; larger levels are moved by rounds of jobs.
HERE = 200_000


def undirected(edges: DataFrame, a: str = "parent", b: str = "child") -> DataFrame:
    """a, b, weight: how many rows link each pair of nodes, in either direction. Rows with a null end are left out."""
    low, high = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    return edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(low, high).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def both_ways(links: DataFrame) -> DataFrame:
    """node, other, weight: each link from both of its ends; one to oneself once, with twice its weight."""
    same = F.col("a") == F.col("b")
    there = links.select(F.col("a").alias("node"), F.col("b").alias("other"), F.when(same, 2 * F.col("weight")).otherwise(F.col("weight")).alias("weight"))
    return there.union(links.where(~same).select("b", "a", "weight"))


def modularity(links: DataFrame, members: DataFrame) -> float:
    """The modularity of a partition; 0 of a graph without links."""
    of = lambda c: members.select(F.col("node").alias(c), F.col("community").alias(f"of_{c}"))
    placed = links.join(of("a"), "a").join(of("b"), "b")
    # Each end of a link adds its weight to its community's degree, and half of it to what is inside if both are there.
    half = F.when(F.col("of_a") == F.col("of_b"), F.col("weight") / 2).otherwise(0.0).alias("inside")
    ends = F.array(*[F.struct(F.col(c).alias("community"), F.col("weight").alias("degree"), half) for c in ("of_a", "of_b")])
    each = placed.select(F.explode(ends).alias("e")).groupBy("e.community").agg(F.sum("e.degree").alias("degree"), F.sum("e.inside").alias("inside"))
    twice, within, squares = each.agg(F.sum("degree"), F.sum("inside"), F.sum(F.col("degree") * F.col("degree"))).head()
    return 2 * within / twice - squares / (twice * twice) if twice else 0.0


def _moved(ways: DataFrame, degrees: DataFrame, members: DataFrame, m: float, turn: int, turns: int, salt: int) -> DataFrame:
    """node, new, lot: the nodes whose turn it is and the neighbouring community in which each gains most, if it gains.

    The weights from a node to its neighbours' communities are summed before the shuffle. Nodes of one turn move at the
    same time; only communities whose turn it is not take nodes in, so two never trade places. `lot` is a number below 4.
    """
    totals = members.join(degrees, "node").groupBy("community").agg(F.sum("degree").alias("total"))
    turn_of = lambda c: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(turns)) == turn
    own = members.where(turn_of("community")).join(degrees, "node")
    others = members.select(F.col("node").alias("other"), F.col("community").alias("to"))
    to = ways.where(F.col("node") != F.col("other")).join(own.select("node"), "node", "left_semi").join(others, "other").groupBy("node", "to").agg(F.sum("weight").alias("k_in"))
    pairs = to.join(own, "node").join(totals.withColumnRenamed("community", "to"), "to")
    # Gain of standing in a community, the node itself not counted in its total.
    stay = F.col("to") == F.col("community")
    rest = F.col("total") - F.when(stay, F.col("degree")).otherwise(0.0)
    scored = pairs.where(stay | ~turn_of("to")).withColumn("gain", F.col("k_in") - F.col("degree") * rest / (2 * m))
    here = F.max(F.when(stay, F.col("gain")))
    best = scored.groupBy("node").agg(F.max_by(F.struct("to", "gain"), F.struct("gain", F.col("to"))).alias("best"), here.alias("here"), F.first("community").alias("community"), F.first("degree").alias("degree"))
    alone = totals.select("community", "total")
    judged = best.join(alone, "community")
    # Without a neighbour in its own community, staying gains what the others of that community cost.
    staying = F.coalesce("here", -F.col("degree") * (F.col("total") - F.col("degree")) / (2 * m))
    lot = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(4)).alias("lot")
    return judged.where(F.col("best.gain") > staying + 1e-12).select("node", F.col("best.to").alias("new"), lot)


@dataclass
class Level:
    """A level of the search: each original node's community, and the partition's modularity."""

    members: DataFrame
    modularity: float


def _one_by_one(links: list[tuple], least: float) -> tuple[dict, float]:
    """(community of each node, modularity) after passes over all nodes, each moved to where it gains most, until a pass gains less than `least`."""
    near: dict = {}
    degree: dict = {}
    m = sum(w for _, _, w in links)
    for a, b, w in links:
        for node in (a, b):
            near.setdefault(node, {})
            degree[node] = degree.get(node, 0.0) + w
        if a != b:
            near[a][b] = near[a].get(b, 0.0) + w
            near[b][a] = near[b].get(a, 0.0) + w
    of, total = {node: node for node in near}, dict(degree)
    while True:
        won = 0.0
        for node in sorted(near):
            own, d, to = of[node], degree[node], {}
            for other, w in near[node].items():
                to[of[other]] = to.get(of[other], 0.0) + w
            total[own] -= d
            gains = {c: k - d * total[c] / (2 * m) for c, k in to.items()}
            stay = gains.get(own, -d * total[own] / (2 * m))
            best, new = max(((g, c) for c, g in gains.items()), default=(stay, own))
            if best > stay + 1e-12:
                of[node] = own = new
                won += (best - stay) / m
            total[own] += d
        if won < least:
            break
    within = sum(w for a, b, w in links if of[a] == of[b])
    return of, within / m - sum((t / (2 * m)) ** 2 for t in total.values())


def _local(links: DataFrame, rounds: int | None, turns: int, least: float = 1e-4) -> tuple[DataFrame, float]:
    """(members, modularity) after local moves from each node alone. A step that does not raise the modularity is not kept.

    Moves go on until they gain nothing more, or for so many rounds. Without such a bound, the driver moves the nodes of
    at most `HERE` links.
    """
    if rounds is None and links.limit(HERE + 1).count() <= HERE:
        rows = links.select("a", "b", "weight").toArrow()
        of, value = _one_by_one(sorted(zip(*(c.to_pylist() for c in rows.columns), strict=True)), least / 1000)
        kind = links.schema["a"].dataType.simpleString()
        made = links.sparkSession.createDataFrame(list(of.items()), f"node {kind}, community {kind}")
        return stored(made, "members"), value
    ways = stored(both_ways(links), "ways")
    degrees = stored(ways.groupBy("node").agg(F.sum("weight").alias("degree")), "degrees")
    m = links.agg(F.sum("weight")).head()[0]
    members = stored(degrees.select("node", F.col("node").alias("community")), "members")
    best = modularity(links, members)
    idle = 0
    for r in itertools.count() if rounds is None else range(rounds):
        before = best
        for turn in range(turns):
            moves = stored(_moved(ways, degrees, members, m, turn, turns, r), "moves")
            # Moves that are good one by one may be bad together; then half of them are made, or a quarter.
            for lots in (4, 2, 1) if not moves.isEmpty() else ():
                tried = members.join(moves.where(F.col("lot") < lots), "node", "left")
                tried = stored(tried.select("node", F.coalesce("new", "community").alias("community")), "members")
                value = modularity(links, tried)
                if value > best:
                    members, best = tried, value
                    break
        # Which communities take nodes in changes by round, so one idle round is no end.
        idle = 0 if best - before >= least else idle + 1
        if idle == IDLE:
            break
    return members, best


def contracted(links: DataFrame, members: DataFrame) -> DataFrame:
    """The links between communities, and those within one as its link to itself, with their summed weights."""
    of = lambda c: members.select(F.col("node").alias(c), F.col("community").alias(f"of_{c}"))
    placed = links.join(of("a"), "a").join(of("b"), "b")
    low, high = F.least("of_a", "of_b"), F.greatest("of_a", "of_b")
    return placed.groupBy(low.alias("a"), high.alias("b")).agg(F.sum("weight").alias("weight"))


def folded(links: DataFrame) -> DataFrame:
    """node, community: a node linked to a single other one, and not to itself, is with that one; the others stand alone.

    In any partition, moving such a leaf to its neighbour's community raises the modularity: its link of weight w gains
    w / m, and costs at most w (2m - w) / 2m^2. So no best partition has a leaf elsewhere. Two nodes that have only each
    other trade names here, no more.
    """
    each = both_ways(links).groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("other").alias("other"))
    return each.select("node", F.when(F.col("n") == 1, F.col("other")).otherwise(F.col("node")).alias("community"))


def louvain(links: DataFrame, levels: int | None = None, rounds: int | None = None, turns: int = 2) -> list[Level]:
    """The levels of the search, each of larger modularity than the one before. A graph without links has none.

    The search ends when neither moves nor another level raise the modularity, or with so many levels, or rounds in one.

    Leaves are folded into their neighbours first, so rounds have rows for the other nodes' links only. Every table has
    a row for each link or node of its level; contraction makes the next level smaller. The names of communities are
    names of nodes. What the original nodes' communities are is joined when a level's members are read.
    """
    found: list[Level] = []
    links = stored(links.select("a", "b", "weight"), "level-links")
    leaves = stored(folded(links), "folded")
    current, inner = stored(contracted(links, leaves), "level-links"), None
    while (levels is None or len(found) < levels) and not current.isEmpty():
        members, value = _local(current, rounds, turns)
        if found and value <= found[-1].modularity + 1e-9:
            break
        to = members.select(F.col("node").alias("community"), F.col("community").alias("new"))
        renamed = lambda before, to=to: before.join(to, "community").select("node", F.col("new").alias("community"))
        inner = members if inner is None else stored(renamed(inner), "level-members")
        names = inner.select(F.col("node").alias("community"), F.col("community").alias("new"))
        found.append(Level(renamed(leaves, names), value))
        current = stored(contracted(current, members), "level-links")
    return found
