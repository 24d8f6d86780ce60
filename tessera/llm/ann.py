"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Nearness is the inner product.  Vectors get one more component, sqrt(M**2 - |v|**2)
with the largest norm M, and queries 0 there; the order by distance is then the order by
inner product, on which graphs can be navigated whatever the norms.

Rows are dealt to shards by hash of the id; the number of shards follows from the row
count (``SHARD_ROWS`` each, but ``SHARDS`` at least), so a shard's memory is bounded and any
row share of one vector does no harm: equal vectors of a shard are one node, which lists its
ids in order.  A graph is a flat neighbour array per layer (-1: none).  Points are inserted in
batches that double in size: each batch searches the graph so far, links to what it finds and among
itself by the usual diversity rule, and its neighbours link back.

Graphs are built once and stored in the shared checkpoint folder as pieces of ``PIECE`` nodes: vectors, ids and
neighbour arrays as binary columns.  They are searched by tasks of one shard and one block of at most about ``ASKED`` queries,
in lock-step, so the work is in numpy and a lost executor costs a block, not a graph.  Each task first measures: ``PROBES`` of its
queries are answered by brute force within the shard, and the breadth of search is doubled from ``BREADTH`` on until the graph finds
``RECALL`` of those answers, at the end by a search as broad as the graph.  So the recall holds for whatever vectors there are.
Each shard returns k candidates a query; they are scored in double precision on the original vectors and merged by rank.

Every row is indexed; recall against brute force is measured by the tests, too.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as
queries or candidates; queries meet candidates of their own dimension only; a query with fewer than k candidates
gets them all; ties go to the smaller id; rows with a null id take no part; repeated rows are candidates of their
own, and all rows with a query's id are left out of its candidates; a query id in several rows is asked once, with its least vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, give_back, stored, table

#: Neighbours of a node above the base layer (twice as many there), breadth of search while building and while asking.
LINKS, BUILD, BREADTH = 16, 64, 100
#: Shards at least, rows of a shard at most (on average): 50,000 x 64 doubles are 26 MB.
SHARDS, SHARD_ROWS = 8, 50_000
#: Queries that go through a graph together; their marks of visited nodes take one byte a node each.
TOGETHER = 256
#: Nodes of one stored piece of a graph; queries of one task, about at most.
PIECE, ASKED = 2048, 20_000
#: Queries of a task that are answered by brute force, and the share of the answers that the graph has to find.
PROBES, RECALL = 48, 0.97
#: Floats that are compared at a time when neighbours link back.
FLOATS = 4 << 20


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Graph:
    """A layered graph over the rows of ``points``; distances are squared Euclidean."""

    def __init__(self, points: np.ndarray, links: int = LINKS, build: int = BUILD, seed: int = 11) -> None:
        self.x = np.ascontiguousarray(points, np.float32)
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        n = len(self.x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(rng.random(n) + 1e-300) / np.log(links)).astype(int), 12) if n else np.zeros(0, int)
        order = rng.permutation(n)
        self.entry = int(order[0]) if n else -1
        if n:
            level[self.entry] = level.max()
        self.layers = [np.full((n, 2 * links if h == 0 else links), -1, np.int32) for h in range(int(level.max()) + 1 if n else 0)]
        self.build, done, size = build, 1, 1
        while done < n:
            batch = order[done : done + size]
            self._insert(batch, level)
            done += len(batch)
            size = min(2 * size, 512, max(1, done // 2))

    @classmethod
    def stored(cls, points: np.ndarray, layers: list[np.ndarray], entry: int) -> Graph:
        """The graph with these neighbour arrays."""
        out = cls.__new__(cls)
        out.x = np.ascontiguousarray(points, np.float32)
        out.norm = np.einsum("ij,ij->i", out.x, out.x)
        out.layers, out.entry = layers, entry
        return out

    def _far(self, q: np.ndarray, qn: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distances of each query to its row of nodes; infinite for -1."""
        d = qn[:, None] + self.norm[nodes] - 2 * np.einsum("ij,ikj->ik", q, self.x[nodes])
        return np.where(nodes < 0, np.inf, d)

    def _search(self, q: np.ndarray, start: np.ndarray, breadth: int, layer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``breadth`` nearest nodes found from ``start`` (one node a query) and their distances, nearest first; -1 where there are none."""
        m, rows = len(q), np.arange(len(q))
        qn = np.einsum("ij,ij->i", q, q)
        best = np.full((m, breadth), -1, np.int64)
        best[:, 0] = start
        far = np.full((m, breadth), np.inf, np.float32)
        far[:, 0] = self._far(q, qn, start[:, None])[:, 0]
        seen = np.zeros((m, len(self.x)), bool)
        seen[rows, start] = True
        opened = best < 0
        act = rows
        while len(act):
            now, dist, shut = best[act], far[act], opened[act]
            pick = np.argmin(np.where(shut, np.inf, dist), axis=1)
            more = ~shut[np.arange(len(act)), pick]
            act, now, dist, shut, pick = act[more], now[more], dist[more], shut[more], pick[more]
            if not len(act):
                break
            own = np.arange(len(act))
            shut[own, pick] = True
            near = layer[now[own, pick]].astype(np.int64)
            near[seen[act[:, None], near]] = -1
            # a neighbour list names no node twice, so marking after the look is enough
            r, c = np.nonzero(near >= 0)
            seen[act[r], near[r, c]] = True
            d = self._far(q[act], qn[act], near).astype(np.float32)
            every, dists = np.concatenate([now, near], 1), np.concatenate([dist, d], 1)
            shut = np.concatenate([shut, near < 0], 1)
            keep = np.argpartition(dists, breadth - 1, axis=1)[:, :breadth]
            best[act], far[act], opened[act] = (np.take_along_axis(v, keep, 1) for v in (every, dists, shut))
            best[act] = np.where(np.isinf(far[act]), -1, best[act])
            opened[act] |= np.isinf(far[act])
        order = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)

    def _diverse(self, nodes: np.ndarray, dist: np.ndarray, most: int) -> np.ndarray:
        """Of each row (nearest first) the nodes that are nearer to the row's own point than to any node chosen before; filled up with the nearest."""
        m, k = nodes.shape
        x = self.x[nodes]
        chosen = np.zeros((m, k), bool)
        for j in range(k):
            if j == 0:
                chosen[:, 0] = nodes[:, 0] >= 0
                continue
            d = self.norm[nodes[:, j]][:, None] + self.norm[nodes[:, :j]] - 2 * np.einsum("ij,ikj->ik", x[:, j], x[:, :j])
            shadowed = ((d < dist[:, j][:, None]) & chosen[:, :j]).any(axis=1)
            chosen[:, j] = (nodes[:, j] >= 0) & ~shadowed & (chosen.sum(axis=1) < most)
        rank = np.where(nodes < 0, 2 * k, np.where(chosen, 0, k) + np.arange(k))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(nodes, order, 1)

    def _insert(self, batch: np.ndarray, level: np.ndarray) -> None:
        q = self.x[batch]
        at = np.full(len(batch), self.entry, np.int64)
        for h in range(len(self.layers) - 1, -1, -1):
            layer, here = self.layers[h], level[batch] >= h
            down = ~here
            if down.any():
                at[down] = self._search(q[down], at[down], 1, layer)[0][:, 0]
            if not here.any():
                continue
            ids, qs = batch[here], q[here]
            near, far = self._search(qs, at[here], self.build, layer)
            at[here] = near[:, 0]
            # points of one batch don't see each other in the graph yet
            peers = self.norm[ids][:, None] + self.norm[ids][None, :] - 2 * qs @ qs.T
            np.fill_diagonal(peers, np.inf)
            width = min(len(ids), self.build)
            close = np.argpartition(peers, width - 1, axis=1)[:, :width]
            near = np.concatenate([near, ids[close]], 1)
            far = np.concatenate([far, np.take_along_axis(peers, close, 1).astype(np.float32)], 1)
            near = np.where(np.isinf(far), -1, near)
            order = np.argsort(far, axis=1, kind="stable")[:, : self.build]
            near, far = np.take_along_axis(near, order, 1), np.take_along_axis(far, order, 1)
            links = self._diverse(near, far, layer.shape[1])
            layer[ids, : links.shape[1]] = links
            self._link_back(layer, ids, links)

    def _link_back(self, layer: np.ndarray, ids: np.ndarray, links: np.ndarray) -> None:
        src = np.repeat(ids, links.shape[1])
        dst = links.ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = layer.shape[1]
        by_count = np.argsort(count, kind="stable")
        at = 0
        while at < len(nodes):
            # as many nodes as fit, padded to the last one's in-degree; a node that many link to is a chunk of its own
            upto = np.arange(at + 1, len(nodes) + 1)
            room = (upto - at) * (width + count[by_count[upto - 1]]) * self.x.shape[1] <= FLOATS
            end = at + max(1, int(room.sum()))
            some = by_count[at:end]
            self._relink(layer, nodes[some], [src[a : a + n] for a, n in zip(first[some].tolist(), count[some].tolist(), strict=True)])
            at = end

    def _relink(self, layer: np.ndarray, nodes: np.ndarray, news: list[np.ndarray]) -> None:
        width = layer.shape[1]
        count = np.array([len(x) for x in news])
        cand = np.full((len(nodes), width + int(count.max())), -1, np.int64)
        cand[:, :width] = layer[nodes]
        r = np.repeat(np.arange(len(nodes)), count)
        cand[r, width + np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = np.concatenate(news)
        # a link may be there already, from the other side of the same batch
        cand.sort(axis=1)
        cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
        dist = np.where(cand < 0, np.inf, self.norm[nodes][:, None] + self.norm[cand] - 2 * np.einsum("ij,ikj->ik", self.x[nodes], self.x[cand])).astype(np.float32)
        order = np.argsort(dist, axis=1, kind="stable")[:, : 2 * width]
        cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
        full = (cand >= 0).sum(axis=1) > width
        kept = cand[:, :width].copy()
        if full.any():
            kept[full] = self._diverse(cand[full], dist[full], width)
        layer[nodes, : kept.shape[1]] = kept

    def nearest(self, q: np.ndarray, k: int, breadth: int = BREADTH) -> np.ndarray:
        """The k nearest nodes found for each query; -1 where there are none."""
        q = np.ascontiguousarray(q, np.float32)
        at = np.full(len(q), self.entry, np.int64)
        for layer in self.layers[:0:-1]:
            at = self._search(q, at, 1, layer)[0][:, 0]
        # no wider than the graph: every node of a small one is found
        return self._search(q, at, max(breadth, k), self.layers[0])[0][:, :k]


class Shard:
    """The nodes of one shard: distinct vectors, the ids that have each (in order), and the graph over them."""

    def __init__(self, wide: np.ndarray, members: np.ndarray, first: np.ndarray, longest: float, graph: Graph | None = None, links: int = LINKS, build: int = BUILD) -> None:
        self.wide, self.members, self.first = wide, members, first
        self.graph = graph or Graph(self._lifted(longest), links, build)

    def _lifted(self, longest: float) -> np.ndarray:
        return np.column_stack([self.wide, np.sqrt(np.maximum(longest**2 - np.einsum("ij,ij->i", self.wide, self.wide), 0))])

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, longest: float, links: int = LINKS, build: int = BUILD) -> Shard:
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        distinct, inverse = np.unique(vectors[order], axis=0, return_inverse=True)
        members = np.argsort(inverse.ravel(), kind="stable")  # by node, ids in order
        first = np.searchsorted(inverse.ravel()[members], np.arange(len(distinct) + 1))
        return cls(distinct.astype(np.float64), ids[members], first, longest, None, links, build)

    def pieces(self, size: int = PIECE) -> Iterator[dict]:
        """Rows of ``PIECES``."""
        g = self.graph
        for k, a in enumerate(range(0, len(self.wide), size)):
            b = min(a + size, len(self.wide))
            yield {
                "piece": k, "entry": g.entry, "vectors": self.wide[a:b].tobytes(), "held": np.diff(self.first[a : b + 1]).astype(np.int32).tobytes(),
                "ids": self.members[self.first[a] : self.first[b]].tobytes(), "layers": [x[a:b].tobytes() for x in g.layers],
            }

    @classmethod
    def read(cls, rows: pd.DataFrame, dim: int, longest: float) -> Shard:
        """From its pieces, in any order."""
        rows = rows.sort_values("piece")
        whole = lambda parts, kind: np.frombuffer(b"".join(parts), kind)
        wide = whole(rows["vectors"], np.float64).reshape(-1, dim)
        first = np.concatenate([[0], np.cumsum(whole(rows["held"], np.int32), dtype=np.int64)])
        layers = [whole(parts, np.int32).reshape(len(wide), -1) for parts in zip(*rows["layers"], strict=True)]
        shard = cls(wide, whole(rows["ids"], np.int64), first, longest, Graph.stored(np.zeros((0, dim + 1)), layers, int(rows["entry"].iloc[0])))
        shard.graph = Graph.stored(shard._lifted(longest), layers, shard.graph.entry)
        return shard

    def breadth_for(self, queries: np.ndarray, k: int, breadth: int, recall: float = RECALL, probes: int = PROBES) -> int:
        """The least breadth, doubled from ``breadth`` on, that finds the wanted share of the best k nodes of some of the queries."""
        some = queries[np.unique(np.linspace(0, len(queries) - 1, min(probes, len(queries))).astype(int))]
        exact = self.wide @ some.T
        k = min(k, len(self.wide))
        # what scores as high as the k-th best counts as found, as ties are settled later
        floor = np.partition(exact, len(exact) - k, axis=0)[len(exact) - k]
        while breadth < len(self.wide):
            found = self.graph.nearest(np.column_stack([some, np.zeros(len(some))]), k, breadth)
            hits = sum(int((exact[nodes[nodes >= 0], j] >= floor[j] - 1e-9 * abs(floor[j])).sum()) for j, nodes in enumerate(found))
            if hits >= recall * k * len(some):
                return breadth
            breadth *= 2
        return len(self.wide)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, breadth: int = BREADTH, recall: float = RECALL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parallel arrays query id, id, inner product: the k best of this shard for each query, its own id left out."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        queries = queries.astype(np.float64)
        breadth = self.breadth_for(queries, k, max(breadth, k + 1), recall)
        # the wider the search, the fewer queries at a time
        together = max(16, TOGETHER * 256 // max(256, breadth))
        for a in range(0, len(queries), together):
            qs, q_ids = queries[a : a + together], query_ids[a : a + together]
            # one more node, as a query's own may hold nothing else
            found = self.graph.nearest(np.column_stack([qs, np.zeros(len(qs))]), k + 1, breadth)
            for q, q_id, nodes in zip(qs, q_ids, found, strict=True):
                nodes = nodes[nodes >= 0]
                scores = (self.wide[nodes] * q).sum(axis=1)
                nodes, scores = nodes[o := np.argsort(-scores, kind="stable")], scores[o]
                # of a node's equal vectors the k + 1 least ids are enough
                own = [self.members[self.first[v] : min(self.first[v + 1], self.first[v] + k + 1)] for v in nodes]
                got = np.concatenate(own) if own else np.zeros(0, np.int64)
                value = np.repeat(scores, [len(x) for x in own])
                keep = got != q_id
                got, value = got[keep], value[keep]
                best = np.lexsort((got, -value))[:k]
                out.append((np.full(len(best), q_id), got[best], value[best]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


PIECES = "__shard int, __dim int, piece int, entry int, vectors binary, held binary, ids binary, layers array<binary>"


def usable_rows(df: DataFrame, is_query: Column, key: str, vector: str) -> DataFrame:
    """__id, __v, __q and __dim of the rows that take part."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("__id"), F.col(f"`{vector}`").cast("array<double>").alias("__v"), F.coalesce(is_query, F.lit(False)).alias("__q"))
    return rows.where(F.col("__id").isNotNull() & usable(F.col("__v"))).withColumn("__dim", F.size("__v"))


def build_index(rows: DataFrame, count: int, longest: float) -> DataFrame:
    """The graphs of ``count`` shards over ``usable_rows``, a row for each piece, stored in the shared checkpoint folder."""
    dealt = rows.select(F.pmod(F.xxhash64("__id"), F.lit(count)).cast("int").alias("__shard"), "__dim", "__id", "__v")

    def build(group: pd.DataFrame) -> pd.DataFrame:
        shard = Shard.of(group["__id"].to_numpy(np.int64), np.stack(group["__v"].to_list()), longest)
        where = {"__shard": group["__shard"].iloc[0], "__dim": group["__dim"].iloc[0]}
        out = pd.DataFrame([where | piece for piece in shard.pieces()])
        give_back()
        return out

    return stored(dealt.groupBy("__shard", "__dim").applyInPandas(build, PIECES))


def nearest(df: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", shards: int = SHARDS, shard_rows: int = SHARD_ROWS, breadth: int = BREADTH, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), ``key``, score: the k rows of largest inner product found for each row that ``is_query`` picks."""
    rows = usable_rows(df, is_query, key, vector)
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("__q").alias("asked"), F.max(F.sqrt(F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x))).alias("longest")).first()
    count, longest = max(shards, -(-about["n"] // shard_rows)), float(about["longest"] or 0.0)
    blocks = max(1, -(-about["asked"] // ASKED))
    index = build_index(rows, count, longest).withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # Each block of queries goes to each shard, as the best of a shard can be anywhere.
    asked = rows.where("__q").groupBy("__id", "__dim").agg(F.min("__v").alias("__v"))
    sent = asked.withColumns({"__block": F.pmod(F.xxhash64("__id", F.lit(7)), F.lit(blocks)).cast("int"), "__shard": F.explode(F.sequence(F.lit(0), F.lit(count - 1)))})

    def search(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(queries):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        shard = Shard.read(index, int(index["__dim"].iloc[0]), longest)
        q, i, s = shard.search(queries["__id"].to_numpy(np.int64), np.stack(queries["__v"].to_list()), k, breadth, recall)
        give_back()
        return pd.DataFrame({"query_id": q, "id": i, "score": s})

    on = ["__shard", "__dim", "__block"]
    found = cut(index.groupBy(*on).cogroup(sent.select(*on, "__id", "__v").groupBy(*on)).applyInPandas(search, "query_id bigint, id bigint, score double"))
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(key), "score")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of ``embeddings`` found for each vec_id divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)
