"""Approximate nearest neighbours by cosine, with robust-pruned directed graphs.

Vectors are dealt by a hash into shards of bounded expected size. In a shard, points enter the graph in batches: a
greedy search from the middle proposes neighbours, and pruning keeps the nearest one and drops those to which it is a
relaxed factor nearer than the point itself, over and over, so that edges stay few and point in many directions; edges
back are added and pruned alike. Queries come in blocks. A block searches each shard with a beam, and the best of all
shards are merged. Scores of what a search returns are worked out anew in double precision on the original vectors.

Equal vectors are one point that keeps its k + 1 smallest ids, all that an answer can hold, so that copies, however
many, neither crowd a shard nor push the right ids out.

Defined results: vectors that are null, empty, zero, or that hold a null or a number that is not finite take no part,
neither as queries nor as answers. Vectors of other lengths than the query's are no candidates. Ties go to the smaller
vec_id. With fewer than k candidates all are returned. Rows that repeat a vec_id count once for each distinct vector.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.llm.common import cut_lineage

SHARD_VECTORS, BLOCK_QUERIES = 4096, 8192
DEGREE, BUILD_BEAM, SEARCH_BEAM, ALPHA, AT_ONCE, BATCH = 32, 64, 80, 1.2, 4, 512
FOUND = "query_id bigint, vec_id bigint, score double"


def beam_search(unit: np.ndarray, edges: np.ndarray, entry: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam nearest points met (-1: none), nearest first, and their squared distances."""
    rows = np.arange(len(queries))
    seen = np.zeros((len(queries), len(unit)), bool)
    ids = np.full((len(queries), beam), -1, np.int32)
    gaps = np.full((len(queries), beam), np.inf, np.float32)
    done = np.ones((len(queries), beam), bool)
    ids[:, 0], done[:, 0] = entry, False
    gaps[:, 0] = ((queries - unit[entry]) ** 2).sum(1)
    seen[:, entry] = True
    active = rows
    while len(active):
        order = np.argsort(done[active], 1, kind="stable")[:, :AT_ONCE]  # the nearest not yet read: the beam is in order
        mine = active[:, None]
        fresh = ~done[mine, order]
        done[mine, order] = True
        near = np.where(fresh[:, :, None], edges[ids[mine, order]], -1).reshape(len(active), -1)
        ok = near >= 0
        ok &= ~seen[mine, np.maximum(near, 0)]
        near = np.where(ok, near, -1)
        near.sort(1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        ok = near >= 0
        width = int(ok.sum(1).max())
        if width:
            at = np.argsort(~ok, 1, kind="stable")[:, :width]
            near = np.take_along_axis(near, at, 1)
            ok = near >= 0
            row, col = np.nonzero(ok)
            seen[active[row], near[row, col]] = True
            gap = np.full(near.shape, np.inf, np.float32)
            gap[ok] = np.maximum(2 - 2 * np.einsum("ij,ij->i", queries[active[row]], unit[near[row, col]]), 0)
            all_ids = np.concatenate([ids[active], near], 1)
            all_gaps = np.concatenate([gaps[active], gap], 1)
            all_done = np.concatenate([done[active], ~ok], 1)
            best = np.argsort(all_gaps, 1, kind="stable")[:, :beam]
            ids[active] = np.take_along_axis(all_ids, best, 1)
            gaps[active] = np.take_along_axis(all_gaps, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
        active = active[~done[active].all(1)]
    return ids, gaps


def robust_prune(unit: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Neighbours (-1: none) of each point, chosen from its row of candidates (-1: none; repeats allowed)."""
    out = np.full((len(points), degree), -1, np.int32)
    candidates = np.sort(candidates, 1)
    candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
    candidates[candidates == points[:, None]] = -1
    rows = np.arange(len(points))
    vectors = unit[np.maximum(candidates, 0)]
    gap = np.maximum(2 - 2 * np.einsum("bcd,bd->bc", vectors, unit[points]), 0)
    gap[candidates < 0] = np.inf
    between = np.maximum(2 - 2 * (vectors @ vectors.transpose(0, 2, 1)), 0)
    for slot in range(degree):
        pick = gap.argmin(1)
        live = np.isfinite(gap[rows, pick])
        if not live.any():
            break
        out[live, slot] = candidates[rows[live], pick[live]]
        gap[(alpha * alpha * between[rows, pick] <= gap) & live[:, None]] = np.inf
        gap[rows, pick] = np.inf
    return out


def build_graph(unit: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """Edges (-1: none) of every point, and where searches begin: the point nearest to the mean."""
    n = len(unit)
    entry = int(((unit - unit.mean(0)) ** 2).sum(1).argmin())
    order = np.random.default_rng(7).permutation(n).astype(np.int32)
    order = np.concatenate(([entry], order[order != entry])).astype(np.int32)
    edges = np.full((n, degree), -1, np.int32)
    at = 0
    while at < n:
        points = order[at : at + (min(BATCH, at) if at else 128)]
        if at:
            found, _ = beam_search(unit, edges, entry, unit[points], beam)
        else:
            found = np.repeat(points[None, :], len(points), 0)
        for lo in range(0, len(points), 128):
            edges[points[lo : lo + 128]] = robust_prune(unit, points[lo : lo + 128], found[lo : lo + 128], alpha, degree)
        source, slot = np.nonzero(edges[points] >= 0)
        to, back = edges[points][source, slot], points[source]
        by = np.argsort(to, kind="stable")
        to, back = to[by], back[by]
        targets, first, size = np.unique(to, return_index=True, return_counts=True)
        have = (edges[targets] >= 0).sum(1)
        room = have + size <= degree
        place = np.arange(len(to)) - np.repeat(first, size) + np.repeat(have, size)
        fits = np.repeat(room, size)
        edges[to[fits], place[fits]] = back[fits]
        over = np.flatnonzero(~room)
        over = over[np.argsort(size[over], kind="stable")]
        lo = 0
        while lo < len(over):
            # as many points at a time as keep the distances among their candidates to some 32 MB
            step = max(1, 8_000_000 // (degree + int(size[over[min(lo + 63, len(over) - 1)]])) ** 2)
            crowded = over[lo : lo + min(step, 64)]
            wide = np.full((len(crowded), degree + int(size[crowded].max())), -1, np.int32)
            wide[:, :degree] = edges[targets[crowded]]
            for row, c in enumerate(crowded):
                wide[row, degree : degree + size[c]] = back[first[c] : first[c] + size[c]]
            edges[targets[crowded]] = robust_prune(unit, targets[crowded], wide, alpha, degree)
            lo += len(crowded)
        at += len(points)
    return edges, entry


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)


def _pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    return np.array(column.to_pylist(), dtype).reshape(len(column), -1)


def cosines(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision, safe from overflow."""
    a, b = (x / np.abs(x).max(1, keepdims=True) for x in (queries, vectors))
    return (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))


def _build(k: int):
    def build(table: pa.Table) -> pa.Table:
        vectors = _matrix(table.column("vector").combine_chunks(), np.float64)
        ids = np.full((len(vectors), k + 1), -1, np.int64)
        for row, own in enumerate(table.column("ids").to_pylist()):
            ids[row, : len(own)] = own
        edges, entry = build_graph(_unit(vectors))
        return pa.table({"dim": table.column("dim")[:1], "shard": table.column("shard")[:1], "graph": pa.array([_pack(vectors=vectors, ids=ids, edges=edges, entry=np.array(entry))], pa.binary())})

    return build


def _search(k: int, beam: int):
    def search(batches):
        for batch in batches:
            for graph, block in zip(batch.column("graph").to_pylist(), batch.column("block_rows").to_pylist()):
                g, q = np.load(io.BytesIO(graph)), np.load(io.BytesIO(block))
                vectors, ids = g["vectors"], g["ids"]
                found, _ = beam_search(_unit(vectors), g["edges"], int(g["entry"]), _unit(q["vectors"]), max(beam, k + 1))
                row, col = np.nonzero(found >= 0)
                at = found[row, col]
                score = cosines(q["vectors"][row], vectors[at])
                row, score, at = np.repeat(row, k + 1), np.repeat(score, k + 1), ids[at].ravel()
                ok = (at >= 0) & (at != q["ids"][row])
                row, score, at = row[ok], score[ok], at[ok]
                order = np.lexsort((at, -score, row))
                row, score, at = row[order], score[order], at[order]
                best = np.arange(len(row)) - np.searchsorted(row, row) < k
                yield pa.record_batch([pa.array(q["ids"][row[best]]), pa.array(at[best]), pa.array(score[best])], names=["query_id", "vec_id", "score"])

    return search


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", shard_vectors: int = SHARD_VECTORS, beam: int = SEARCH_BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors to each row of queries, itself left out."""

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        return rows.where("id is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)").withColumn("dim", F.size("vector"))

    ranked = usable(vectors).distinct().withColumn("r", F.row_number().over(Window.partitionBy("dim", "vector").orderBy("id"))).where(f"r <= {k + 1}")
    points = cut_lineage(ranked.groupBy("dim", "vector").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    shards = max(1, -(-points.count() // shard_vectors))
    graphs = cut_lineage(points.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int")).groupBy("dim", "shard").applyInArrow(_build(k), "dim int, shard int, graph binary"))

    asked = usable(queries).distinct()
    blocks = max(1, -(-asked.count() // BLOCK_QUERIES))

    def block(table: pa.Table) -> pa.Table:
        rows = _pack(ids=table.column("id").to_numpy(), vectors=_matrix(table.column("vector").combine_chunks(), np.float64))
        return pa.table({"dim": table.column("dim")[:1], "block": table.column("block")[:1], "block_rows": pa.array([rows], pa.binary())})

    packed = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).groupBy("dim", "block").applyInArrow(block, "dim int, block int, block_rows binary")
    # every block meets every shard once, as an equi-join on the block number that each shard is given
    tasks = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(packed.hint("shuffle_hash"), ["dim", "block"]).select("shard", "block", "graph", "block_rows")
    spread = tasks.repartition(max(1, min(shards * blocks, 4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "shard", "block")
    found = spread.mapInArrow(_search(k, beam), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("query_id", "rank", "vec_id", "score")
