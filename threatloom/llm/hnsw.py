"""Approximate nearest neighbours by hierarchical navigable small-world graphs, one per shard.

Distinct vectors are dealt into shards by hash. Each shard becomes one row: its vectors and,
per layer, a flat array of neighbours of fixed width (-1 fills). A node belongs to layer l with
chance M^-l. In each layer a node is linked to nodes near it, nearest first, where a candidate
that is nearer to a link already chosen than to the node is passed over; links run both ways.
Queries go to every shard of their dimension in blocks. A search walks down the layers with a
beam, and all queries of a block walk together. Shard results are merged by exact distance.

Equal vectors are one node that carries its smallest ids, as many as any answer can use.
"""

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threatloom.llm.frames import kept_in_table, quoted

SHARD_ROWS = 8192
QUERY_BLOCK = 1024
M = 16
BEAM = 160
UPPER_BEAM = 24
_CHUNK = 256


# ---- one graph, in numpy ------------------------------------------------------------------


def _nearest(vectors: np.ndarray, k: int) -> np.ndarray:
    """For each row the k nearest other rows, nearest first."""
    n = len(vectors)
    k = min(k, n - 1)
    norms = (vectors * vectors).sum(axis=1)
    out = np.empty((n, k), np.int32)
    for a in range(0, n, _CHUNK):
        far = norms[None, :] - 2 * vectors[a : a + _CHUNK] @ vectors.T
        rows = np.arange(len(far))
        far[rows, a + rows] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        order = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        out[a : a + _CHUNK] = np.take_along_axis(near, order, axis=1)
    return out


def _spread_out(vectors: np.ndarray, near: np.ndarray, links: int) -> np.ndarray:
    """Of each node's candidates, up to `links` that are nearer to the node than to any link chosen before."""
    n, k = near.shape
    chosen = np.full((n, links), -1, np.int32)
    for a in range(0, n, _CHUNK):
        who = near[a : a + _CHUNK]
        points = vectors[who]
        own = ((points - vectors[a : a + _CHUNK, None, :]) ** 2).sum(axis=2)
        squares = (points * points).sum(axis=2)
        between = squares[:, :, None] + squares[:, None, :] - 2 * points @ points.transpose(0, 2, 1)
        taken = np.zeros(who.shape, bool)
        count = np.zeros(len(who), np.int64)
        for j in range(k):
            nearest_link = np.where(taken, between[:, j, :], np.inf).min(axis=1)
            fits = (count < links) & (own[:, j] < nearest_link)
            taken[:, j] = fits
            chosen[a : a + _CHUNK][np.flatnonzero(fits), count[fits]] = who[fits, j]
            count += fits
    return chosen


def _both_ways(vectors: np.ndarray, chosen: np.ndarray, width: int) -> np.ndarray:
    """Links and their reverses, the nearest `width` of each node in a flat table."""
    n = len(chosen)
    a, j = np.nonzero(chosen >= 0)
    b = chosen[a, j]
    pairs = np.unique(np.concatenate([a.astype(np.int64) * n + b, b.astype(np.int64) * n + a]))
    left, right = pairs // n, pairs % n
    far = np.concatenate([((vectors[left[s : s + 65536]] - vectors[right[s : s + 65536]]) ** 2).sum(axis=1) for s in range(0, len(pairs), 65536)] or [np.zeros(0)])
    order = np.lexsort((far, left))
    left, right = left[order], right[order]
    place = np.arange(len(left)) - np.searchsorted(left, left)
    table = np.full((n, width), -1, np.int32)
    keep = place < width
    table[left[keep], place[keep]] = right[keep]
    return table


def build(vectors: np.ndarray, seed: int = 0, m: int = M) -> list[tuple[np.ndarray, np.ndarray]]:
    """Layers from the bottom up: (nodes, neighbours), neighbours as node numbers of the shard."""
    chance = np.random.default_rng(seed).random(len(vectors))
    height = np.floor(-np.log(np.maximum(chance, 1e-12)) / np.log(m)).astype(int)
    layers = []
    for level in range(int(height.max(initial=0)) + 1):
        nodes = np.flatnonzero(height >= level).astype(np.int32)
        width = 2 * m
        if len(nodes) == 1:
            layers.append((nodes, np.full((1, width), -1, np.int32)))
            continue
        here = vectors[nodes]
        table = _both_ways(here, _spread_out(here, _nearest(here, 3 * m), m), width)
        layers.append((nodes, np.where(table >= 0, nodes[table], -1).astype(np.int32)))
    return layers


def _beam_search(vectors: np.ndarray, table: np.ndarray, queries: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and squared distances of the `beam` nearest met from `start`, nearest first. table: neighbours by node number."""
    count, n = len(queries), len(vectors)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, n + 1), bool)
    seen[:, n] = True  # -1 looks here
    nodes = start.astype(np.int32)
    seen[rows, nodes] = True
    far = np.where(nodes >= 0, ((vectors[nodes] - queries[:, None, :]) ** 2).sum(axis=2), np.inf)
    done = nodes < 0
    active = np.arange(count)
    while len(active):
        # The two nearest unopened nodes of each query that still has any.
        open_far = np.where(done[active], np.inf, far[active])
        pick = np.argpartition(open_far, 1, axis=1)[:, :2] if open_far.shape[1] > 2 else np.argsort(open_far, axis=1)[:, :2]
        usable = np.take_along_axis(open_far, pick, axis=1) < np.inf
        alive = usable.any(axis=1)
        active, pick, usable = active[alive], pick[alive], usable[alive]
        if not len(active):
            break
        done[active[:, None], pick] = True
        opened = np.where(usable, nodes[active[:, None], pick], -1)
        around = np.where(opened[:, :, None] >= 0, table[opened], -1).reshape(len(active), -1)
        fresh = ~seen[active[:, None], around]
        # The same node may be a neighbour of both: the later mention counts as seen.
        order = np.sort(np.where(fresh, around, -1), axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = -1
        seen[active[:, None], order] = True
        gaps = np.where(order >= 0, ((vectors[order] - queries[active][:, None, :]) ** 2).sum(axis=2), np.inf)
        all_nodes = np.concatenate([nodes[active], order], axis=1)
        all_far = np.concatenate([far[active], gaps], axis=1)
        all_done = np.concatenate([done[active], order < 0], axis=1)
        size = min(beam, all_far.shape[1])
        best = np.argpartition(all_far, size - 1, axis=1)[:, :size]
        if nodes.shape[1] < size:
            grow = ((0, 0), (0, size - nodes.shape[1]))
            nodes, far, done = np.pad(nodes, grow, constant_values=-1), np.pad(far, grow, constant_values=np.inf), np.pad(done, grow, constant_values=True)
        nodes[active, :size] = np.take_along_axis(all_nodes, best, axis=1)
        far[active, :size] = np.take_along_axis(all_far, best, axis=1)
        done[active, :size] = np.take_along_axis(all_done, best, axis=1)
    order = np.argsort(far, axis=1, kind="stable")
    return np.take_along_axis(nodes, order, axis=1), np.take_along_axis(far, order, axis=1)


def search(vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], queries: np.ndarray, k: int, beam: int = BEAM) -> np.ndarray:
    """Node numbers of about the k nearest of each query (-1 fills): the beam narrows to k at the bottom layer."""
    start = np.repeat(layers[-1][0][None, :1], len(queries), axis=0)
    for level in range(len(layers) - 1, -1, -1):
        nodes, neighbours = layers[level]
        table = np.full((len(vectors) + 1, neighbours.shape[1]), -1, np.int32)
        table[nodes] = neighbours
        found, _ = _beam_search(vectors, table, queries, start, max(beam, k) if level == 0 else UPPER_BEAM)
        start = found
    return start[:, : max(k, 1)]


@dataclass(frozen=True)
class Scale:
    """How a shard's vectors are brought near 1 for the search: a power of two, the precision, and the largest value kept.

    Single precision serves vectors whose largest components lie within a factor of a million;
    others are searched in double precision. Values beyond `most` are as far as `most` from any other.
    """

    power: int
    kind: type
    most: float

    @staticmethod
    def of(vectors: np.ndarray) -> "Scale":
        sizes = np.abs(vectors).max(axis=1)
        middle = _power(float(np.median(sizes)))
        wide = _power(float(sizes.min())) - _power(float(sizes.max())) > 20
        return Scale(middle, np.float64, 1e150) if wide else Scale(middle, np.float32, 1e15)

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.ldexp(vectors, self.power), -self.most, self.most).astype(self.kind)


def _power(size: float) -> int:
    return -int(np.frexp(size)[1])


def _distances(vectors: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, at any magnitude."""
    with np.errstate(over="ignore"):
        gaps = vectors - to
        plain = np.sqrt((gaps * gaps).sum(axis=1))
    odd = ~np.isfinite(plain) | (plain < 1e-140)
    if odd.any():
        gaps = np.ldexp(vectors[odd], -1) - np.ldexp(to, -1)
        power = _power(float(np.abs(gaps).max()))
        plain[odd] = np.ldexp(np.sqrt((np.ldexp(gaps, power) ** 2).sum(axis=1)), 1 - power)
    return plain


# ---- shards in Spark ------------------------------------------------------------------------


def _usable(frame: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector exists, is not empty or zero, and has finite components only."""
    v = quoted(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return frame.filter(v.isNotNull() & fine)


def _matrix(column: pa.ChunkedArray, dtype=np.float64) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    return flat.flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)


_GRAPH = "dim int, shard int, vectors binary, levels array<int>, nodes binary, neighbours binary, owners array<array<long>>"


def index(embeddings: DataFrame, keep: int, vec_id: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, m: int = M) -> DataFrame:
    """One row per shard with its graph. keep: how many ids, the smallest, each distinct vector carries."""
    rows = _usable(embeddings.select(quoted(vec_id).alias("id"), quoted(vector).cast("array<double>").alias("v")), "v").filter("id IS NOT NULL")
    # A vector that a third of all rows share is cut down to its smallest ids on the map side.
    ranked = rows.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("rank") <= keep)
    nodes = kept_in_table(ranked.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("owners")), "hnsw-nodes")
    shards = max(1, ceil(nodes.count() / shard_rows))
    placed = nodes.select(F.size("v").alias("dim"), F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard"), "v", "owners")

    def make(group: pa.Table) -> pa.Table:
        # Sorted by first id, so that the graph does not depend on the order of arrival.
        group = group.take(np.argsort([o[0] for o in group["owners"].to_pylist()], kind="stable"))
        vectors = _matrix(group["v"])
        layers = build(Scale.of(vectors)(vectors), seed=int(group["shard"][0].as_py()), m=m)
        return pa.table(
            {
                "dim": pa.array([vectors.shape[1]], pa.int32()),
                "shard": group["shard"].slice(0, 1).cast(pa.int32()),
                "vectors": pa.array([vectors.tobytes()], pa.binary()),
                "levels": pa.array([[len(nodes) for nodes, _ in layers]], pa.list_(pa.int32())),
                "nodes": pa.array([b"".join(nodes.tobytes() for nodes, _ in layers)], pa.binary()),
                "neighbours": pa.array([b"".join(table.tobytes() for _, table in layers)], pa.binary()),
                "owners": pa.array([group["owners"].to_pylist()], pa.list_(pa.list_(pa.int64()))),
            }
        )

    return kept_in_table(placed.groupBy("dim", "shard").applyInArrow(make, _GRAPH), "hnsw-graphs")


def _layers(row: dict, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    nodes, neighbours = np.frombuffer(row["nodes"], np.int32), np.frombuffer(row["neighbours"], np.int32).reshape(-1, width)
    ends = np.cumsum(row["levels"])
    return [(nodes[e - size : e], neighbours[e - size : e]) for e, size in zip(ends, row["levels"], strict=True)]


def nearest(
    embeddings: DataFrame, queries: DataFrame, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, beam: int = BEAM, m: int = M,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: about the k nearest of each query among all other ids, by Euclidean distance.

    Scores are exact, in double precision; ties go to the smaller id. Vectors that are null,
    empty, zero or hold a null or non-finite component take no part on either side, nor do rows
    without id; vectors of different length are never compared. A repeated (id, vector) row
    counts once. Fewer candidates than k give all of them, none give no rows.
    """
    graphs = index(embeddings, k + 1, vec_id, vector, shard_rows, m)
    asked = _usable(queries.select(quoted(vec_id).alias("query_id"), quoted(vector).cast("array<double>").alias("q")), "q")
    asked = kept_in_table(asked.filter("query_id IS NOT NULL").distinct(), "hnsw-queries")
    blocks = max(1, ceil(asked.count() / QUERY_BLOCK))
    places = graphs.select(F.col("dim").alias("dim"), F.col("shard").alias("shard"))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("dim", F.size("q"))
    # Every block meets every shard of its dimension: once each, as (shard, block) groups of bounded size.
    sent = numbered.join(places, "dim")
    copies = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(graph: pa.Table, group: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if graph.num_rows and group.num_rows:
            row = graph.to_pylist()[0]
            vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
            asked_ids, asked_for = group["query_id"].to_numpy(), _matrix(group["q"])
            scale = Scale.of(vectors)
            found = search(scale(vectors), _layers(row, 2 * m), scale(asked_for), k + 1, beam)
            for i, nodes in enumerate(found):
                nodes = nodes[nodes >= 0]
                scores = _distances(vectors[nodes], asked_for[i])
                pairs = sorted((s, o) for s, node in zip(scores.tolist(), nodes.tolist(), strict=True) for o in row["owners"][node] if o != asked_ids[i])[:k]
                out["query_id"] += [int(asked_ids[i])] * len(pairs)
                out["score"] += [p[0] for p in pairs]
                out["vec_id"] += [p[1] for p in pairs]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    keys = ("dim", "shard", "block")
    found = copies.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
