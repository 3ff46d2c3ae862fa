"""Exact top-k search by inner product with M-trees.

Vectors are dealt into shards by a hash of their id, and each shard is an M-tree of
paged nodes: every entry of a node has its routing vector, covering radius, and
distance to the node's own routing vector. A block of queries goes down a tree
best-first. Since ``<q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2``, a lower bound of the
distance bounds the score; a subtree is left out when no query can gain from it, and
an entry before its distance is computed, when the stored distance to its parent
tells by the triangle inequality. The best of all shards are merged.
"""

from __future__ import annotations

import heapq
import sys
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAGE = 48  # entries of a node
SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
SLACK = 1e-6  # above the rounding of a distance; scores themselves are exact


@dataclass
class Node:
    rows: np.ndarray  # routing vector of each entry, as a row of the shard
    to_parent: np.ndarray  # distance of each entry to this node's routing vector
    radius: np.ndarray  # covering radius of each entry; 0 in a leaf
    longest: np.ndarray  # greatest squared length below each entry
    children: list[Node] = field(default_factory=list)  # none in a leaf


def distances(points: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = lengths[a][:, None] + lengths[b][None, :] - 2 * (points[a] @ points[b].T)
    return np.sqrt(np.maximum(squared, 0))


def build(points: np.ndarray, lengths: np.ndarray, rows: np.ndarray, pivot: int, rng: np.random.Generator) -> Node:
    """Bulk load: choose routing vectors, give each row to its nearest, go on below."""
    if len(rows) <= PAGE:
        to_parent = distances(points, lengths, rows, np.array([pivot]))[:, 0]
        return Node(rows, to_parent, np.zeros(len(rows)), lengths[rows])
    n = min(PAGE, -(-len(rows) // PAGE))
    chosen = rng.choice(rows, n, replace=False)
    near = distances(points, lengths, rows, chosen).argmin(axis=1)
    if (near == near[0]).all():  # equal vectors: any even split will do
        near = np.arange(len(rows)) % n
    used = np.unique(near)
    groups, chosen = [rows[near == g] for g in used], chosen[used]
    radius = [distances(points, lengths, g, np.array([c])).max() for g, c in zip(groups, chosen, strict=True)]
    return Node(
        chosen,
        distances(points, lengths, chosen, np.array([pivot]))[:, 0],
        np.array(radius),
        np.array([lengths[g].max() for g in groups]),
        [build(points, lengths, g, c, rng) for g, c in zip(groups, chosen, strict=True)],
    )


def search(points: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and score of the ``k`` best rows of each query, its own id left out.

    Best-first over the tree for all queries of the block: nodes are taken by the
    best bound any query has on them, and each node serves the queries it can help.
    """
    lengths = (points * points).sum(axis=1)
    own_length = (queries * queries).sum(axis=1)
    best = np.full((len(queries), k), -np.inf)
    best_id = np.full((len(queries), k), np.iinfo(np.int64).max)
    root = build(points, lengths, np.arange(len(points)), 0, np.random.default_rng(0))
    first = np.sqrt(np.maximum(own_length + lengths[0] - 2 * (queries @ points[0]), 0))
    queue, count = [(-np.inf, 0, root, np.full(len(queries), np.inf), first)], 1
    while queue:
        _, _, node, bound, to_node = heapq.heappop(queue)
        active = np.flatnonzero(bound >= best[:, -1])
        if not len(active):
            continue
        # what the stored distances tell before any new distance is computed
        apart = np.maximum(np.abs(to_node[active][:, None] - node.to_parent) - node.radius - SLACK, 0)
        hope = (own_length[active][:, None] + node.longest - apart * apart) / 2 + SLACK
        wanted = hope >= best[active, -1][:, None]
        entries, active_rows = np.flatnonzero(wanted.any(axis=0)), wanted.any(axis=1)
        if not len(entries):
            continue
        active, wanted = active[active_rows], wanted[active_rows][:, entries]
        rows = node.rows[entries]
        score = queries[active] @ points[rows].T
        if not node.children:
            score = np.where(ids[rows][None, :] == own[active][:, None], -np.inf, score)
            merged = np.concatenate([best[active], score], axis=1)
            merged_id = np.concatenate([best_id[active], np.broadcast_to(ids[rows], score.shape)], axis=1)
            order = np.lexsort((merged_id, -merged), axis=1)[:, :k]
            best[active] = np.take_along_axis(merged, order, 1)
            best_id[active] = np.take_along_axis(merged_id, order, 1)
            continue
        away = np.sqrt(np.maximum(own_length[active][:, None] + lengths[rows] - 2 * score, 0))
        apart = np.maximum(away - node.radius[entries] - SLACK, 0)
        hope = (own_length[active][:, None] + node.longest[entries] - apart * apart) / 2
        hope = np.minimum(hope, score + np.sqrt(own_length[active])[:, None] * node.radius[entries]) + SLACK
        for j, entry in enumerate(entries):
            below, way = np.full(len(queries), -np.inf), np.zeros(len(queries))
            below[active] = np.where(wanted[:, j], hope[:, j], -np.inf)
            way[active] = away[:, j]
            if (below >= best[:, -1]).any() and below.max() > -np.inf:
                heapq.heappush(queue, (-below.max(), count, node.children[entry], below, way))
                count += 1
    found = np.isfinite(best)
    return np.nonzero(found)[0], best_id[found], best[found].astype(np.int64)


def whole_components(vector: Column) -> Column:
    """``floor(64 * x)`` of each component, or null for a vector that takes no part."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * 64)))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 20, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` greatest integer inner products of each query.

    Queries are the rows of ``vectors`` for which ``queries`` holds; candidates are
    all rows of another id; ties go to the smaller id. Vectors that are null or hold
    a null or non-finite component take no part, nor do rows without id. Shorter
    vectors count as filled up with zeros. An id names one vector: of rows that
    repeat an id the smallest array counts. An empty table gives no rows.
    Components beyond 2^18 could make scores inexact.
    """
    rows = vectors.select(
        vectors[f"`{vec_id}`"].cast("long").alias("vec_id"), whole_components(vectors[f"`{vector}`"]).alias("x"), queries.alias("asks")
    ).where("vec_id IS NOT NULL AND x IS NOT NULL")
    rows = rows.groupBy("vec_id").agg(F.min("x").alias("x"), F.max("asks").alias("asks"))
    n = rows.agg(F.count("*"), F.count_if("asks")).first()
    n_shards, n_blocks = max(1, -(-n[0] // SHARD_ROWS)), max(1, -(-n[1] // BLOCK_QUERIES))
    shard = F.pmod(F.xxhash64("vec_id"), F.lit(n_shards)).cast("int")
    block = F.pmod(F.xxhash64(F.lit(1), F.col("vec_id")), F.lit(n_blocks)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    candidates = rows.select("vec_id", "x", shard.alias("shard"), spread(n_blocks).alias("block"))
    asked = rows.where("asks").select("vec_id", "x", block.alias("block"), spread(n_shards).alias("shard"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        left, right = left.sort_values("vec_id"), right.sort_values("vec_id")
        width = max(left["x"].map(len).max(), right["x"].map(len).max(), 1)
        own = right["vec_id"].to_numpy()
        at, ids, scores = search(matrix(left["x"], width), left["vec_id"].to_numpy(), matrix(right["x"], width), own, k)
        return pd.DataFrame({"query_id": own[at], "vec_id": ids, "score": scores})

    local = candidates.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(
        run, "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def top_k_sql(k: int = 20, every: int = 20, table: str = "embeddings") -> str:
    return f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM {table}
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
    FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r
          FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
                FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {every} = 0))
    WHERE r <= {k}"""
