"""Approximate nearest neighbours with vantage-point trees, one for each shard of the vectors.

A vantage-point tree of a bounded sample deals all vectors to cells; a cell is hashed into shards of about `SHARD`
rows, and each shard's own tree is built once, in a task of its own, and kept as a row of arrays. A query first
searches its own cell. The distance of its k-th nearest there then tells which other cells the triangle inequality
leaves open, and only those get the query. Queries of a cell are grouped in blocks of about `BLOCK`, so that each pair
of shard and block is a task of bounded size, whatever key is hot.

A node of a tree splits its rows by rank of distance to its vantage point and keeps the least and largest distance of
either half, so that equal vectors split as well. A subtree, and a cell, is pruned if its bound, times `factor`,
exceeds the distance of the k-th nearest so far. Factor one is exact; larger factors prune more.

Defined cases: vectors that are null, empty, zero or that hold null or non-finite components take no part, nor do rows
without an id; vectors of different lengths have no distance, so a query finds vectors of its own length; all rows that
repeat a vec_id can be found, but none of the query's own id; of queries with one id the least vector asks; equal
distances go by vec_id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Nearest rows wanted, relaxing factor, rows of a shard, of a block of queries and of a leaf.
K, FACTOR, SHARD, BLOCK, LEAF = 10, 1.0, 4096, 2048, 32
#: Rows (about) of the sample that deals vectors to cells, and of it in a cell at least.
SAMPLE, CELL_SAMPLE = 4096, 8
#: Distances are sums of squares in double precision; bounds are loosened by this share so that rounding prunes nothing.
SLACK = 1e-9


def distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Euclidean distances (queries x rows), the sum running over the components in their order for every pair."""
    out = np.zeros((len(queries), len(rows)))
    for j in range(rows.shape[1]):
        diff = queries[:, j, None] - rows[None, :, j]
        out += diff * diff
    return np.sqrt(out)


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, nodes); a node has start, end, near's end, the bounds of both halves, and its children (-1: leaf)."""
    order = np.arange(len(vectors))
    nodes: list[list[float]] = []

    def split(start: int, end: int) -> int:
        me = len(nodes)
        nodes.append([start, end, -1, 0, 0, 0, 0, -1, -1])
        if end - start > leaf:
            own = order[start:end]
            # The vantage point is the row farthest from the first: rows at the rim split best.
            far = int(np.argmax(distances(vectors[own[:1]], vectors[own])[0]))
            own[[0, far]] = own[[far, 0]]
            d = distances(vectors[own[:1]], vectors[own[1:]])[0]
            by = np.argsort(d, kind="stable")
            order[start], order[start + 1 : end] = own[0], own[1:][by]
            d = d[by]
            half = len(d) // 2
            middle = start + 1 + half
            nodes[me][2:7] = [middle, d[0], d[half - 1], d[half], d[-1]]
            nodes[me][7] = split(start + 1, middle)
            nodes[me][8] = split(middle, end)
        return me

    if len(vectors):
        split(0, len(vectors))
    return order, np.array(nodes, float).reshape(-1, 9)


def open_within(bound: np.ndarray, reach: np.ndarray, factor: float) -> np.ndarray:
    """Whether rows at a distance of `bound` or more may be within `reach`."""
    return bound * factor * (1 - SLACK) - SLACK <= reach


class Cells:
    """A vantage-point tree whose leaves are cells: rows nearer than a node's threshold are in its first half."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.sample, self.nodes, self.cells = sample, [], 0
        self._split(np.arange(len(sample)), cells)

    def _split(self, own: np.ndarray, cells: int) -> int:
        me = len(self.nodes)
        self.nodes.append([-1, 0.0, -1, -1, self.cells])  # vantage point, threshold, halves, cell
        if cells > 1 and len(own) >= 2 * CELL_SAMPLE:
            far = own[int(np.argmax(distances(self.sample[own[:1]], self.sample[own])[0]))]
            d = distances(self.sample[[far]], self.sample[own])[0]
            threshold = float(np.median(d))
            if (d < threshold).any():
                halves = self._split(own[d < threshold], cells // 2), self._split(own[d >= threshold], cells - cells // 2)
                self.nodes[me] = [int(far), threshold, *halves, -1]
                return me
        self.cells += 1
        return me

    def _distance(self, node: list, rows: np.ndarray) -> np.ndarray:
        return distances(rows, self.sample[node[0] : node[0] + 1])[:, 0]

    def home(self, rows: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        out, todo = np.zeros(len(rows), np.int64), [(0, np.arange(len(rows)))]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if node[0] < 0:
                out[who] = node[4]
            elif len(who):
                near = self._distance(node, rows[who]) < node[1]
                todo += [(node[2], who[near]), (node[3], who[~near])]
        return out

    def within(self, rows: np.ndarray, reach: np.ndarray, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) for every cell that may have vectors within a row's reach."""
        found, todo = [(np.empty(0, np.int64), np.empty(0, np.int64))], [(0, np.arange(len(rows)))]
        while todo:
            at, who = todo.pop()
            node = self.nodes[at]
            if node[0] < 0:
                found.append((who, np.full(len(who), node[4])))
            elif len(who):
                d = self._distance(node, rows[who])
                for child, bound in ((node[2], d - node[1]), (node[3], node[1] - d)):
                    todo.append((child, who[open_within(np.maximum(bound, 0), reach[who], factor)]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Searcher:
    """Nearest rows of a block of queries in one tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nodes: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, limit: np.ndarray | None = None):
        self.ids, self.vectors, self.nodes, self.query_ids, self.queries, self.k, self.factor = ids, vectors, nodes, query_ids, queries, k, factor
        #: Distance of each query's k-th nearest in what was searched before.
        self.limit = np.full(len(queries), np.inf) if limit is None else limit
        self.best = np.full((len(queries), k), np.inf)
        self.found = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.leaf_of = np.full(len(queries), -1)

    def _offer(self, who: np.ndarray, start: int, end: int, d: np.ndarray | None = None) -> np.ndarray:
        d = distances(self.queries[who], self.vectors[start:end]) if d is None else d
        ids = np.broadcast_to(self.ids[start:end], d.shape)
        shown = np.where(ids == self.query_ids[who][:, None], np.inf, d)
        every_d, every_i = np.hstack([self.best[who], shown]), np.hstack([self.found[who], np.where(np.isinf(shown), np.iinfo(np.int64).max, ids)])
        by = np.lexsort((every_i, every_d), axis=1)[:, : self.k]
        self.best[who], self.found[who] = np.take_along_axis(every_d, by, 1), np.take_along_axis(every_i, by, 1)
        return d

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.nodes) and len(self.queries):
            self._descend(0, np.arange(len(self.queries)))
            self._visit(0, np.arange(len(self.queries)))
        return self.best, self.found

    def _descend(self, node: int, who: np.ndarray) -> None:
        start, end, middle, _, near_max, far_min, _, near, far = self.nodes[node]
        if near < 0:
            self._offer(who, int(start), int(end))
            self.leaf_of[who] = node
            return
        d = distances(self.queries[who], self.vectors[int(start) : int(start) + 1])[:, 0]
        inside = d < (near_max + far_min) / 2
        for child, chosen in ((near, who[inside]), (far, who[~inside])):
            if len(chosen):
                self._descend(int(child), chosen)

    def _visit(self, node: int, who: np.ndarray) -> None:
        start, end, middle, near_min, near_max, far_min, far_max, near, far = self.nodes[node]
        if near < 0:
            who = who[self.leaf_of[who] != node]
            if len(who):
                self._offer(who, int(start), int(end))
            return
        d = self._offer(who, int(start), int(start) + 1)[:, 0]
        halves = [(int(near), np.maximum(near_min - d, d - near_max)), (int(far), np.maximum(far_min - d, d - far_max))]
        for child, bound in halves:
            still = open_within(bound, np.minimum(self.best[who, -1], self.limit[who]), self.factor)
            if still.any():
                self._visit(child, who[still])


def usable(embedding: Column) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, float) for x in column])


def _pruned(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_VECTORS = "vec_id long, embedding array<double>, width int, cell long, row long"


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, shard_rows: int = SHARD, block_rows: int = BLOCK, sample_rows: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every query among the vectors but itself. Both have vec_id, embedding."""
    spark = vectors.sparkSession
    clean = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("width", F.size("embedding"))
    rows, asked = clean(vectors), clean(queries)
    commonest = rows.groupBy("width").count().orderBy(F.desc("count"), "width").head()
    if commonest is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n = commonest["width"], commonest["count"]
    # The sample is bounded: a share of the rows by hash, and never more than twice what is asked for.
    share = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(1 << 30)) < int(min(1.0, sample_rows / n) * (1 << 30))
    sample = rows.where((F.col("width") == width) & share).select("embedding").limit(2 * sample_rows).collect() if n > shard_rows else []
    cells = Cells(np.array([r["embedding"] for r in sample], float).reshape(-1, width), -(-n // shard_rows))

    def home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 36
        for pdf in batches:
            at = np.zeros(len(pdf), np.int64)
            usual = (pdf["width"] == width).to_numpy()
            if usual.any():
                at[usual] = cells.home(_matrix(pdf["embedding"][usual]))
            yield pdf.assign(cell=at, row=np.arange(row, row + len(pdf)))
            row += len(pdf)

    placed = stored(rows.mapInPandas(home, _VECTORS), "vp-cells")
    sizes = placed.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n")).select("width", "cell", F.ceil(F.col("n") / shard_rows).alias("shards"))
    sizes = stored(sizes, "vp-sizes")

    def index(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = _matrix(pdf["embedding"])
        order, nodes = build(x)
        return pd.DataFrame([(*key, pdf["vec_id"].to_numpy(np.int64)[order].tobytes(), x[order].tobytes(), nodes.tobytes())], columns=["width", "cell", "shard", "ids", "vectors", "nodes"])

    sharded = placed.join(sizes, ["width", "cell"]).withColumn("shard", F.pmod(F.xxhash64("row"), F.col("shards")))
    trees = stored(sharded.groupBy("width", "cell", "shard").applyInPandas(index, "width int, cell long, shard long, ids binary, vectors binary, nodes binary"), "vp-trees")

    def search(key: tuple, tree: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        if tree.empty or ask.empty:
            return pd.DataFrame({"query_id": np.array([], np.int64), "vec_id": np.array([], np.int64), "score": np.array([], float)})
        t, w = tree.iloc[0], int(key[0])
        double = lambda b, w: np.frombuffer(b, float).reshape(-1, w)
        ask = ask.sort_values("query_id", kind="stable")
        query_ids = ask["query_id"].to_numpy(np.int64)
        best, found = Searcher(np.frombuffer(t["ids"], np.int64), double(t["vectors"], w), double(t["nodes"], 9), query_ids, _matrix(ask["embedding"]), k, factor, ask["reach"].to_numpy(float)).run()
        real = np.isfinite(best)
        return pd.DataFrame({"query_id": np.repeat(query_ids, k).reshape(best.shape)[real], "vec_id": found[real], "score": best[real]})

    def searched(requests: DataFrame) -> DataFrame:
        """query_id, vec_id, score: the nearest in each shard of the cells that queries ask. requests: query_id, embedding, width, cell, reach."""
        blocks = requests.groupBy("width", "cell").agg(F.count(F.lit(1)).alias("n")).select("width", "cell", F.ceil(F.col("n") / block_rows).alias("blocks"))
        both = sizes.join(blocks, ["width", "cell"])
        left = trees.join(both.select("width", "cell", "blocks"), ["width", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = requests.join(both, ["width", "cell"]).withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        keys = ("width", "cell", "shard", "block")
        return left.drop("blocks").groupBy(*keys).cogroup(right.select("query_id", "embedding", "reach", *keys).groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score double")

    asked = asked.groupBy("vec_id", "width").agg(F.min("embedding").alias("embedding")).groupBy("vec_id").agg(F.min(F.struct("embedding", "width")).alias("x")).select("vec_id", "x.embedding", "x.width")
    first = stored(asked.mapInPandas(home, _VECTORS).select(F.col("vec_id").alias("query_id"), "embedding", "width", "cell", F.lit(float("inf")).alias("reach")), "vp-queries")
    near = stored(_pruned(searched(first), k).drop("rank"), "vp-near")
    if cells.cells == 1:
        found = near
    else:
        reach = near.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.max("score")).otherwise(F.lit(float("inf"))).alias("near_reach"))
        asks = first.where(F.col("width") == width).join(reach, "query_id", "left").select("query_id", "embedding", "width", F.col("cell").alias("home"), F.coalesce("near_reach", F.lit(float("inf"))).alias("reach"))

        def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    who, cell = cells.within(_matrix(part["embedding"]), part["reach"].to_numpy(float), factor)
                    out = part.iloc[who].assign(cell=cell)
                    yield out[out["cell"] != out["home"]].drop(columns="home")

        requests = stored(asks.mapInPandas(others, "query_id long, embedding array<double>, width int, reach double, cell long"), "vp-requests")
        found = near.unionByName(searched(requests))
    return _pruned(found, k).select("query_id", "rank", "vec_id", "score")
