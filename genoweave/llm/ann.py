"""Approximate nearest neighbours by a robust-pruned directed graph in each shard.

Distinct vectors are dealt to shards of bounded size. In a shard points join the
graph in batches: a greedy search from the entry point proposes neighbours, relaxed
distance pruning keeps edges of different directions, and edges back are pruned the
same way. Graphs are built once and stored. A query runs a beam search in every
shard, and the shards' best are ranked together by the exact inner product.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoweave.plans.durable import write_table

K = 20
QUERY_STEP = 20
#: Vectors of a shard, queries of a block, edges of a node, candidates while building and searching, and the relaxation.
SHARD = 16_384
QUERY_BLOCK = 16_384
EDGES = 32
BEAM_BUILD = 64
BEAM_SEARCH = 128
RELAX = 1.2


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors with one component more, so that all have one length: nearest then means largest inner product."""
    squares = (vectors.astype(np.float64) ** 2).sum(1)
    more = np.sqrt(np.maximum(squares.max() - squares, 0)) if len(vectors) else squares
    return np.concatenate([vectors, more[:, None]], 1).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ids and negative inner products of the best ``beam`` points met, nearest first; id -1 where there are fewer."""
    out_ids, out_cost = [], []
    width = 4
    for a in range(0, len(queries), 256):
        q = queries[a : a + 256]
        rows = np.arange(len(q))
        ids = np.full((len(q), beam), -1, np.int64)
        cost = np.full((len(q), beam), np.inf, np.float32)
        open_ = np.zeros((len(q), beam), bool)
        met = np.zeros((len(q), len(points) + 1), bool)
        ids[:, 0], cost[:, 0], open_[:, 0] = entry, -(q @ points[entry]), True
        met[:, entry] = met[:, -1] = True
        while len(rows):
            # the nearest unexpanded candidates of each query, in order of cost
            rank = np.cumsum(open_[rows], 1)
            pick = open_[rows] & (rank <= width)
            busy = pick.any(1)
            rows, pick = rows[busy], pick[busy]
            if not len(rows):
                break
            slot = np.full((len(rows), width), -1, np.int64)
            r, c = np.nonzero(pick)
            slot[r, rank[busy][r, c] - 1] = ids[rows[r], c]
            open_[rows[r], c] = False
            near = np.where((slot >= 0)[:, :, None], graph[slot], -1).reshape(len(rows), -1)
            near = np.sort(near, 1)
            fresh = ~met[rows[:, None], near]
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            most = int(fresh.sum(1).max())
            if most == 0:
                continue
            order = np.argsort(~fresh, 1, kind="stable")[:, :most]
            near = np.where(np.take_along_axis(fresh, order, 1), np.take_along_axis(near, order, 1), -1)
            met[rows[:, None], near] = True
            far = -np.matmul(points[near], q[rows][:, :, None])[:, :, 0]
            far[near < 0] = np.inf
            all_ids = np.concatenate([ids[rows], near], 1)
            all_cost = np.concatenate([cost[rows], far], 1)
            all_open = np.concatenate([open_[rows], near >= 0], 1)
            best = np.argsort(all_cost, 1, kind="stable")[:, :beam]
            ids[rows], cost[rows], open_[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_cost, all_open))
            open_[rows] &= np.isfinite(cost[rows])
        out_ids.append(ids)
        out_cost.append(cost)
    return np.concatenate(out_ids), np.concatenate(out_cost)


def robust_prune(points: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, edges: int = EDGES, relax: float = RELAX) -> np.ndarray:
    """For each node at most ``edges`` of its candidates (-1: none): the nearest, then the nearest that no kept one is closer to by the factor ``relax``."""
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == nodes[:, None]] = -1
    vectors = points[candidates]
    own = ((vectors - points[nodes][:, None]) ** 2).sum(2)
    own[candidates < 0] = np.inf
    order = np.argsort(own, 1, kind="stable")
    own, candidates = np.take_along_axis(own, order, 1), np.take_along_axis(candidates, order, 1)
    vectors = np.take_along_axis(vectors, order[:, :, None], 1)
    alive = np.isfinite(own)
    out = np.full((len(nodes), edges), -1, np.int64)
    rows = np.arange(len(nodes))
    for k in range(edges):
        some = alive.any(1)
        if not some.any():
            break
        first = alive.argmax(1)
        out[some, k] = candidates[rows, first][some]
        gap = ((vectors - vectors[rows, first][:, None]) ** 2).sum(2)
        alive &= relax * relax * gap > own
        alive[rows, first] = False
    return out


def build_graph(points: np.ndarray, edges: int = EDGES, beam: int = BEAM_BUILD, seed: int = 0) -> tuple[np.ndarray, int]:
    """Edges of every point (-1: none) and the entry point, the one nearest to the mean."""
    n = len(points)
    room = edges + edges // 2
    graph = np.full((n, room), -1, np.int64)
    entry = int(np.argmin(((points - points.mean(0)) ** 2).sum(1)))
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    at, step = 1, 1
    while at < n:
        batch = order[at : at + step]
        found, _ = beam_search(points, graph, entry, points[batch], beam)
        if len(batch) > 1:  # the batch's own points are not in the graph yet
            mates = batch[np.random.default_rng(at).integers(0, len(batch), (len(batch), 8))]
            found = np.concatenate([found, mates], 1)
        chosen = robust_prune(points, batch, found, edges)
        graph[batch, :edges] = chosen
        # Edges back, in order of their target; full targets are pruned.
        source, target = np.repeat(batch, edges), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else np.zeros(0, np.int64)
        sizes = np.diff(np.concatenate([heads, [len(target)]])).astype(np.int64)
        within = np.arange(len(target)) - np.repeat(heads, sizes)
        nodes = target[heads]
        held = (graph[nodes] >= 0).sum(1)
        fits = held + sizes <= room
        fit = np.repeat(fits, sizes)
        # a node's edges stand at its left, without holes
        packed = np.take_along_axis(graph[nodes], np.argsort(graph[nodes] < 0, 1, kind="stable"), 1)
        graph[nodes] = packed
        place = np.repeat(held, sizes) + within
        graph[target[fit], place[fit]] = source[fit]
        full = nodes[~fits]
        if len(full):
            most = int(sizes[~fits].max())
            extra = np.full((len(full), most), -1, np.int64)
            number = np.repeat(np.cumsum(~fits) - 1, sizes)[~fit]
            extra[number, within[~fit]] = source[~fit]
            for a in range(0, len(full), 512):
                part = slice(a, a + 512)
                kept = robust_prune(points, full[part], np.concatenate([graph[full[part]], extra[part]], 1), edges)
                graph[full[part]] = -1
                graph[full[part], :edges] = kept
        at += len(batch)
        step = min(512, max(1, at // 2))
    return graph, entry


def usable(embedding: str = "embedding"):
    """Vectors that take part: not null, no null or non-finite component, not all zero."""
    return F.expr(
        f"{embedding} is not null and size({embedding}) > 0 and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists({embedding}, x -> x <> 0)"
    )


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column]) if len(column) else np.zeros((0, 1))


def build_shard(index: pd.DataFrame) -> pd.DataFrame:
    """A shard's graphs, one row for each length of vectors: size, reps, vectors, graph (all as bytes) and entry."""
    out = []
    for size, some in index.sort_values("rep").groupby(index.embedding.map(len)):
        vectors = _stack(some.embedding)
        graph, entry = build_graph(lifted(vectors))
        narrow = vectors.astype(np.float32)
        held = narrow if (narrow == vectors).all() else vectors
        out.append((int(size), some.rep.to_numpy(np.int64).tobytes(), held.tobytes(), graph.astype(np.int32).tobytes(), entry))
    return pd.DataFrame(out, columns=["size", "reps", "vectors", "graph", "entry"])


def search_shard(graphs: pd.DataFrame, queries: pd.DataFrame, k: int = K + 1) -> pd.DataFrame:
    """The best ``k`` vectors of a shard for each query of a block: (query, rep, score)."""
    out = {"query": [np.zeros(0, np.int64)], "rep": [np.zeros(0, np.int64)], "score": [np.zeros(0)]}
    for stored in graphs.itertuples():
        asked = queries[queries.asked.map(len) == stored.size].sort_values("query")
        if not len(asked):
            continue
        reps = np.frombuffer(stored.reps, np.int64)
        kind = np.float32 if len(stored.vectors) == 4 * len(reps) * stored.size else np.float64
        vectors = np.frombuffer(stored.vectors, kind).reshape(len(reps), -1).astype(np.float64)
        graph = np.frombuffer(stored.graph, np.int32).reshape(len(reps), -1).astype(np.int64)
        q, names = _stack(asked.asked), asked["query"].to_numpy()
        q_lifted = np.concatenate([q, np.zeros((len(q), 1))], 1).astype(np.float32)
        found, _ = beam_search(lifted(vectors), graph, stored.entry, q_lifted, max(BEAM_SEARCH, k))
        for a in range(0, len(q), 256):
            ids = found[a : a + 256]
            exact = (vectors[ids] * q[a : a + 256][:, None]).sum(2)
            exact[ids < 0] = -np.inf
            rep = np.where(ids >= 0, reps[ids], np.iinfo(np.int64).max)
            order = np.lexsort([rep, -exact], axis=1)[:, :k]
            rep, exact = np.take_along_axis(rep, order, 1), np.take_along_axis(exact, order, 1)
            real = np.isfinite(exact)
            out["query"].append(np.repeat(names[a : a + 256], real.sum(1)))
            out["rep"].append(rep[real])
            out["score"].append(exact[real])
    return pd.DataFrame({c: np.concatenate(v) for c, v in out.items()}).astype({"query": "int64", "rep": "int64", "score": "float64"})


def _build(key: tuple, index: pd.DataFrame) -> pd.DataFrame:
    return build_shard(index).assign(shard=int(key[0]))


def _search(key: tuple, graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    return search_shard(graphs, queries)


def build_index(reps: DataFrame, shards: int) -> DataFrame:
    """Rows (size, reps, vectors, graph, entry, shard) of distinct vectors (rep, embedding): each shard's graph, built once, one shard a task."""
    shard = F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")
    placed = reps.select("rep", "embedding", shard.alias("shard")).repartitionById(shards, F.col("shard"))
    return write_table(placed.groupBy("shard").applyInPandas(_build, "size int, reps binary, vectors binary, graph binary, entry int, shard int"), "graphs")


def search_index(graphs: DataFrame, queries: DataFrame, shards: int, blocks: int) -> DataFrame:
    """Rows (query, rep, score): every query (query, asked) in every shard. Each shard's stored graph meets each block of queries in a task of its own."""
    block = F.pmod(F.xxhash64("query", F.lit("block")), F.lit(blocks)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = graphs.withColumn("block", each(blocks)).withColumn("pair", F.col("shard") * blocks + F.col("block"))
    wanted = queries.select("query", "asked", block.alias("block"), each(shards).alias("shard")).select("query", "asked", (F.col("shard") * blocks + F.col("block")).alias("pair"))
    index, wanted = (x.repartitionById(shards * blocks, F.col("pair")) for x in (index.drop("shard", "block"), wanted))
    return index.groupBy("pair").cogroup(wanted.groupBy("pair")).applyInPandas(_search, "query long, rep long, score double")


def search_every(embeddings: DataFrame, step: int = QUERY_STEP, k: int = K) -> DataFrame:
    """The ``k`` nearest rows (largest inner product) of every row whose vec_id is divisible by ``step``.

    Rows (query_id, rank, vec_id, score). Equal vectors are indexed once, as their
    least vec_id, with the k + 1 least ids of the copies: no more of them can be in
    a result. A query's own row is left out. Rows with a null id or an unusable
    vector take no part; vectors are compared with those of their own length. A
    vec_id on several rows counts once, with its least vector.
    """
    rows = embeddings.where(F.col("vec_id").isNotNull() & usable()).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = write_table(rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit("second"), "embedding")), "vectors")
    same = W.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    reps = few.groupBy("h1", "h2").agg(
        F.min("vec_id").alias("rep"), F.sort_array(F.collect_list("vec_id")).alias("copies"), F.min_by("embedding", "vec_id").alias("embedding")
    )
    reps = write_table(reps, "distinct-vectors")
    asked = write_table(
        rows.where(F.col("vec_id") % step == 0).select("vec_id", "h1", "h2").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query")),
        "queries",
    )
    shards = max(1, -(-reps.count() // SHARD))
    distinct = asked.select("query").distinct()
    blocks = max(1, -(-distinct.count() // QUERY_BLOCK))
    queries = reps.select(F.col("rep").alias("query"), F.col("embedding").alias("asked")).join(distinct, "query", "left_semi")
    found = search_index(build_index(reps, shards), queries, shards, blocks)
    best = W.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    expanded = top.join(reps.select("rep", "copies"), "rep").select("query", "score", F.explode("copies").alias("vec_id"))
    nearest = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    listed = expanded.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= k + 1)
    lists = listed.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return asked.join(lists, "query").select("query_id", F.posexplode(others).alias("p", "x")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )
