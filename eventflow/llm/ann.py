"""Approximate nearest neighbours by cosine with learned partitions.

A bounded sample of the vectors gets a neighbour graph, which is cut into balanced parts: median
splits along principal directions, then moves that put neighbours into one part within its room. A
small network learns to say which parts a vector's neighbours lie in. It places every row in its most
probable partition and routes each query to its several most probable ones. How many is measured: a
bounded set of trial vectors, none of which the router was trained on, is compared with all rows by brute
force, and the least number of partitions is taken that holds ``RECALL`` of their true neighbours.
Candidates are scored exactly. Tables of fewer than ``LEAST_ROWS`` vectors are one partition.

Equal vectors are indexed once for each of their k + 1 smallest ids, which are the only ones that can
be among k nearest, and equal queries are searched once, so copies cost nothing. Rows and queries of a
partition meet block by block; a large partition is many tasks.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or are not of
the most frequent dimension take no part, as rows or queries; ties go to the smaller id; with fewer
candidates than k all are returned; rows without an id take no part; repeated rows (same id) count
once; an empty table gives an empty table; columns other than id and vector, whatever their names, are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import saved

SAMPLE, TRIALS, GRAPH, RECALL = 4000, 200, 10, 0.97
ROWS_PER_PARTITION, MOST_PARTITIONS, LEAST_ROWS = 1500, 256, 200
ROW_BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass
class Router:
    """One hidden layer; ``parts`` logits."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(unit(x) @ self.hidden + self.hidden_bias, 0) @ self.out + self.out_bias


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square over- or underflows."""
    x = np.asarray(x, np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """n x k, nearest first, blockwise."""
    x = unit(x).astype(np.float32)
    out = []
    for at in range(0, len(x), 512):
        s = x[at : at + 512] @ x.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -2
        out.append(np.argsort(-s, axis=1, kind="stable")[:, :k])
    return np.concatenate(out)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, passes: int = 8, seed: int = 0) -> np.ndarray:
    """Part of each row: parts of nearly equal size that cut few edges."""
    x, n = unit(x), len(x)
    part = np.zeros(n, int)
    for level in range(parts.bit_length() - 1):
        new = part * 2
        for p in range(1 << level):
            rows = np.flatnonzero(part == p)
            if len(rows) > 1:
                centred = x[rows] - x[rows].mean(axis=0)
                direction = np.linalg.svd(centred, full_matrices=False)[2][0]
                order = np.argsort(centred @ direction, kind="stable")
                new[rows[order[len(rows) // 2 :]]] += 1
        part = new
    nearby: list[list[int]] = [[] for _ in range(n)]
    for i, row in enumerate(graph.tolist()):
        for j in row:
            nearby[i].append(j)
            nearby[j].append(i)
    room = int(np.ceil(n / parts * (1 + slack)))
    size = np.bincount(part, minlength=parts)
    g = np.random.default_rng(seed)
    for _ in range(passes):
        moved = 0
        for i in g.permutation(n):
            count = np.bincount(part[nearby[i]], minlength=parts) * (size < room)
            best = int(count.argmax())
            if count[best] > (part[nearby[i]] == part[i]).sum():
                size[part[i]] -= 1
                size[best] += 1
                part[i] = best
                moved += 1
        if moved < n // 200:
            break
    return part


def learn_router(x: np.ndarray, parts: int, graph_k: int = GRAPH, width: int = 64, epochs: int = 30, rate: float = 0.005, seed: int = 0) -> Router:
    g = np.random.default_rng(seed)
    dim = x.shape[1]
    r = Router(g.normal(0, dim**-0.5, (dim, width)), np.zeros(width), g.normal(0, width**-0.5, (width, parts)), np.zeros(parts))
    if parts == 1 or len(x) < 2:
        return r
    graph = neighbour_graph(x, min(graph_k, len(x) - 1))
    part = balanced_parts(x, graph, parts)
    near = np.concatenate([part[:, None], part[graph]], axis=1)
    goal = np.zeros((len(x), parts))
    np.add.at(goal, (np.arange(len(x))[:, None], near), 1 / near.shape[1])
    u = unit(x)
    params = [r.hidden, r.hidden_bias, r.out, r.out_bias]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = g.permutation(len(u))
        for at in range(0, len(u), 128):
            rows = order[at : at + 128]
            h = np.maximum(u[rows] @ r.hidden + r.hidden_bias, 0)
            z = h @ r.out + r.out_bias
            e = np.exp(z - z.max(axis=1, keepdims=True))
            d = (e / e.sum(axis=1, keepdims=True) - goal[rows]) / len(rows)
            dh = (d @ r.out.T) * (h > 0)
            step += 1
            for p, grad, (m, v) in zip(params, (u[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)), state, strict=True):
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return r


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows, in double precision and the same for equal rows wherever they stand."""
    a, b = np.ascontiguousarray(a, np.float64), np.ascontiguousarray(b, np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def nearest(queries: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(ids, scores) of the k nearest rows of each query, ties to smaller ids."""
    out = []
    u = unit(rows)
    for at in range(0, len(queries), 256):
        s = unit(queries[at : at + 256]) @ u.T
        bar = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
        for i in range(len(s)):
            # All that may be among the k nearest, whatever the product's rounding.
            near = np.flatnonzero(s[i] >= bar[i] - 1e-9)
            score = cosine(np.broadcast_to(queries[at + i], (len(near), rows.shape[1])), rows[near])
            order = np.lexsort((ids[near], -score))[:k]
            out.append((ids[near][order], score[order]))
    return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec) of the rows that take part, each id once."""
    v = F.col(vector)
    fine = vectors.select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull())
    fine = fine.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0))
    dim = fine.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").head()
    fine = fine.where(F.size("vec") == (dim["dim"] if dim else 0))
    # -0.0 and 0.0 are one value.
    return fine.groupBy("id").agg(F.min(F.transform("vec", lambda x: x + F.lit(0.0))).alias("vec"))


def parts_for(total: int) -> int:
    """Partitions for so many indexed rows, a power of two: about a fifth of the root of the rows, and in
    larger tables one for each ROWS_PER_PARTITION."""
    if total < LEAST_ROWS:
        return 1
    return 1 << min(int(np.log2(max(total**0.5 / 5, total / ROWS_PER_PARTITION, 2))), MOST_PARTITIONS.bit_length() - 1)


def split_sample(firsts: DataFrame, sample: int) -> tuple[DataFrame, DataFrame]:
    """Two bounded sets of rows without a row in common, by the hash of the id: at most about ``sample``
    to train on and TRIALS to measure on; of small tables four fifths and one fifth."""
    total, span = max(firsts.count(), 1), 1 << 30
    train = int(span * min(0.8, sample / total))
    trial = int(span * min(0.2, TRIALS / total))
    h = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(span))
    return firsts.where(h < train), firsts.where(h >= span - trial)


@dataclass
class Layout:
    """Rows by partition, the router (none for a single partition), sizes, partitions to probe."""

    placed: DataFrame
    router: Broadcast
    sizes: np.ndarray
    probes: int


def lay_out(index: DataFrame, k: int, sample: int = SAMPLE, recall: float = RECALL) -> Layout:
    """Learns the partitions of the indexed rows (id, vec, copy) and how many to probe."""
    spark = index.sparkSession
    parts = parts_for(index.count())
    taken, trials = ([sorted((r["id"], r["vec"]) for r in s.collect()) for s in split_sample(index.where("copy = 1"), sample)] if parts > 1 else ([], []))
    parts = parts if len(taken) >= 8 * parts and trials else 1
    x = np.array([v for _, v in taken], np.float64)
    router = spark.sparkContext.broadcast(learn_router(x, parts) if parts > 1 else None)

    @F.pandas_udf("int")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(router.value.logits(_matrix(b)).argmax(axis=1) if parts > 1 and len(b) else np.zeros(len(b), int), dtype="int32")

    placed = saved(index.select("id", "vec", place("vec").alias("part")), "placed")
    sizes = np.zeros(parts, np.int64)
    for r in placed.groupBy("part").count().collect():  # one row a partition
        sizes[r["part"]] = r["count"]
    probes = _probes(placed, np.array([v for _, v in trials], np.float64), router.value, parts, k, recall) if parts > 1 else 1
    return Layout(placed, router, sizes, probes)


def search(vectors: DataFrame, is_query, k: int = 5, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, recall: float = RECALL) -> DataFrame:
    """(query_id, rank, <key>, score): the k nearest of every row for which the column ``is_query``
    (of ``id``) holds, among all others."""
    spark = vectors.sparkSession
    rows = saved(usable(vectors, key, vector), "vectors")
    ranked = rows.withColumn("copy", F.row_number().over(W.partitionBy("vec").orderBy("id"))).where(F.col("copy") <= k + 1)
    index = saved(ranked, "index")
    layout = lay_out(index, k, sample, recall)
    placed, router, sizes, probes, parts = layout.placed, layout.router, layout.sizes, layout.probes, len(layout.sizes)

    queries = rows.where(is_query)
    distinct = queries.groupBy("vec").agg(F.min("id").alias("q"))

    @F.pandas_udf("array<int>")
    def route(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            if parts == 1 or not len(b):
                yield pd.Series([[0]] * len(b))
                continue
            order = np.argsort(-router.value.logits(_matrix(b)), axis=1, kind="stable")
            # At least ``probes``, and as many as hold enough rows.
            enough = (np.cumsum(sizes[order], axis=1) < k + 1).sum(axis=1) + 1
            yield pd.Series([o[: max(probes, e)].tolist() for o, e in zip(order, enough, strict=True)])

    routed = saved(distinct.select("q", "vec", F.explode(route("vec")).alias("part")), "routed")
    asked = {r["part"]: r["count"] for r in routed.groupBy("part").count().collect()}
    shape = spark.createDataFrame([(p, int(-(-sizes[p] // ROW_BLOCK)), int(-(-asked.get(p, 0) // QUERY_BLOCK))) for p in range(parts)], "part int, row_blocks int, query_blocks int")
    shape = F.broadcast(shape.where("row_blocks > 0 and query_blocks > 0"))  # at most MOST_PARTITIONS rows
    block = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = routed.join(shape, "part").select("part", block("q", "query_blocks").alias("qb"), every("row_blocks").alias("rb"), "q", "vec")
    right = placed.join(shape, "part").select("part", block("id", "row_blocks").alias("rb"), every("query_blocks").alias("qb"), "id", "vec")

    def meet(asking: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        if not len(asking) or not len(there):
            return pd.DataFrame({"q": [], "id": [], "score": []}).astype({"q": "int64", "id": "int64", "score": "float64"})
        found = nearest(_matrix(asking["vec"]), _matrix(there["vec"]), there["id"].to_numpy(np.int64), k + 1)
        return pd.DataFrame({"q": np.repeat(asking["q"].to_numpy(np.int64), [len(i) for i, _ in found]), "id": np.concatenate([i for i, _ in found]), "score": np.concatenate([s for _, s in found])})

    groups = ["part", "rb", "qb"]
    met = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInPandas(meet, "q long, id long, score double")
    best = met.withColumn("n", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1).drop("n")
    each = queries.select(F.col("id").alias("query_id"), "vec").join(distinct, "vec").select("query_id", "q").join(best, "q").where("query_id <> id")
    final = each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
    return final.select("query_id", "rank", F.col("id").alias(key), "score")


def _probes(placed: DataFrame, trials: np.ndarray, router: Router, parts: int, k: int, recall: float) -> int:
    """Least number of partitions that hold enough of the trial vectors' true neighbours."""
    shared = placed.sparkSession.sparkContext.broadcast(trials)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                found = nearest(shared.value, _matrix(b["vec"]), np.arange(len(b)), k + 1)
                at = np.concatenate([i for i, _ in found])
                yield pd.DataFrame({"t": np.repeat(np.arange(len(found)), [len(i) for i, _ in found]), "score": np.concatenate([s for _, s in found]), "id": b["id"].to_numpy()[at], "part": b["part"].to_numpy()[at]})

    near = placed.mapInPandas(scan, "t int, score double, id long, part int")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("t").orderBy(F.desc("score"), "id"))).where(F.col("n") <= k + 1)
    rank = np.argsort(np.argsort(-router.logits(trials), axis=1, kind="stable"), axis=1)
    # The nearest of a trial vector is itself; at most TRIALS * (k + 1) rows.
    places = np.sort([rank[r["t"], r["part"]] for r in near.where("n > 1").collect()])
    return int(places[min(len(places) - 1, int(np.ceil(recall * len(places))) - 1)]) + 1 if len(places) else parts


def brute_force(vectors: dict[int, list[float]], queries: list[int], k: int) -> dict[int, list[tuple[int, float]]]:
    """For tests."""
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        others = ids != q
        found, score = nearest(np.array([vectors[q]], np.float64), x[others], ids[others], k)[0]
        out[q] = list(zip(found.tolist(), score.tolist(), strict=True))
    return out
