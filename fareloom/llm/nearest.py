"""Approximate nearest neighbours by inner product: inverted lists with adaptive dimension scans.

Vectors go to the list of their nearest centroid and are stored rotated by a fixed random
rotation, in column blocks. A query scans some lists. In each, the squared distance over the
first columns, scaled to all columns, is held against the distance that would still reach
the query's current best results (per candidate, as norms may differ); a candidate for which
a hypothesis test rejects that is abandoned, so most candidates cost a few columns only.
Survivors are scored exactly on the original vectors in double precision.

A query's nearest list is scanned first; its results are the starting bar in the others.
Copies of a vector are one entry with their smallest ids, so a vector held by a third of all
rows is one candidate and one query. Lists are cut into row blocks and query blocks, and each
pair of blocks is a group of bounded size.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take
no part; those of several dimensions are searched dimension by dimension, each among its own,
as there is no inner product between them; rows of equal id and vector count once; rows of an id are never results of queries with that
id; fewer candidates than ``k`` give all; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.llm.common import stored


@dataclass(frozen=True)
class Search:
    """``k`` results; ``probe``: share of the lists a query scans (for data without clusters;
    less will do where there are some); ``max_lists`` and ``sample_per_list`` bound the index's
    training sample and the centroids that are broadcast; ``block`` columns per test; ``doubt``:
    the test's width in standard deviations; ``rows``/``queries`` of a group."""

    k: int = 20
    probe: float = 0.75
    max_lists: int = 4096
    sample_per_list: int = 64
    block: int = 16
    doubt: float = 2.1
    rows: int = 8192
    queries: int = 2048
    seed: int = 17


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def train_lists(sample: np.ndarray, lists: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Centroids by Lloyd's rounds; an empty list keeps its place."""
    centroids = sample[np.random.default_rng(seed).permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        at = nearest_list(sample, centroids)
        size = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, sample)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


def nearest_list(x: np.ndarray, centroids: np.ndarray, block: int = 1024) -> np.ndarray:
    """Block by block, so that no more than ``block`` distances a centroid are held at once."""
    half = 0.5 * (centroids * centroids).sum(axis=1)
    return np.concatenate([(x[a:a + block] @ centroids.T - half).argmax(axis=1) for a in range(0, max(1, len(x)), block)])


def scan(queries: np.ndarray, rotated_queries: np.ndarray, rows: np.ndarray, rotated: np.ndarray, ids: np.ndarray, bar: np.ndarray,
         k: int, search: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query numbers, row numbers and exact scores of each query's best ``k`` rows above its bar.

    ``bar``: a score that ``k`` results elsewhere already reach (-inf: none).
    """
    dim = queries.shape[1]
    q_norm, x_norm = (rotated_queries ** 2).sum(axis=1), (rotated ** 2).sum(axis=1)
    bar = bar.copy()
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    step = max(1, (1 << 16) // max(1, len(queries)))
    for a in range(0, len(rows), step):
        x = rotated[a:a + step]
        part = first = None
        for d in range(0, dim, search.block):
            e = min(dim, d + search.block)
            if part is None:  # the first block of columns, all pairs at once
                qc, xc = rotated_queries[:, :e], x[:, :e]
                first = (qc ** 2).sum(axis=1)[:, None] + (xc ** 2).sum(axis=1) - 2 * (qc @ xc.T)
                q, r = np.indices(first.shape).reshape(2, -1)
                part = first.ravel()
            else:
                part = part + ((rotated_queries[q, d:e] - x[r, d:e]) ** 2).sum(axis=1)
            # reaching the bar means a squared distance of at most |q|^2 + |x|^2 - 2 bar
            reach = q_norm[q] + x_norm[a + r] - 2 * bar[q]
            slack = (1 + search.doubt / np.sqrt(e)) ** 2 if e < dim else 1 + 1e-6
            keep = part * (dim / e) <= np.maximum(reach, 0) * slack + 1e-9
            q, r, part = q[keep], r[keep], part[keep]
            if not len(q):
                break
        if not len(q):
            continue
        # sums in order of the components, so that a score does not depend on the batch
        score = np.concatenate([np.add.accumulate(queries[q[i:i + 4096]] * rows[a + r[i:i + 4096]], axis=1)[:, -1] for i in range(0, len(q), 4096)])
        q, r, score = (np.concatenate(pair) for pair in zip(best, (q, a + r, score)))
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        start = np.searchsorted(q, q)
        rank = np.arange(len(q)) - start
        full = rank == k - 1
        bar[q[full]] = np.maximum(bar[q[full]], score[full])
        best = q[rank < k], r[rank < k], score[rank < k]
    return best


def _usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _packed(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of equally long binary vectors as a matrix of doubles."""
    column = batch.column(name).to_pylist()
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _listed(entries: DataFrame, centroids: np.ndarray, turn: np.ndarray, probes: int) -> DataFrame:
    """``vid, vh, list, place, vector, rotated``: each vector at its nearest list (``probes`` 0), or
    once for each of the ``probes`` lists with the largest inner product of the centroid."""
    shared = entries.sparkSession.sparkContext.broadcast((centroids, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, rotate = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lists = part.column("vector")
                x = np.asarray(lists.flatten(), np.float64).reshape(part.num_rows, -1)
                home = nearest_list(x, centers)[:, None]
                if probes:
                    affinity = x @ centers.T
                    affinity[np.arange(len(x)), home[:, 0]] = np.inf  # its own list comes first
                    home = np.argsort(-affinity, axis=1, kind="stable")[:, :probes]
                at, place = np.repeat(np.arange(len(x)), home.shape[1]), np.tile(np.arange(home.shape[1]), len(x))
                body, turned = [v.tobytes() for v in x], [v.tobytes() for v in x @ rotate.T]
                yield pa.RecordBatch.from_arrays(
                    [part.column("vid").take(pa.array(at)), part.column("vh").take(pa.array(at)), pa.array(home.ravel().astype(np.int32)),
                     pa.array(place.astype(np.int32)), pa.array([body[i] for i in at], pa.binary()), pa.array([turned[i] for i in at], pa.binary())],
                    ["vid", "vh", "list", "place", "vector", "rotated"])

    return entries.select("vid", "vh", "vector").mapInArrow(run, "vid long, vh long, list int, place int, vector binary, rotated binary")


def _scanned(index: DataFrame, probes: DataFrame, k: int, search: Search) -> DataFrame:
    """``vid, vh, to_vid, to_vh, score``: the best ``k`` of each group for each of its queries.

    ``probes`` has a ``bar`` column.
    """
    sizes = index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / search.rows).cast("int").alias("row_blocks")) \
        .join(probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / search.queries).cast("int").alias("query_blocks")), "list")
    sizes = F.broadcast(sizes)  # one row per list, at most max_lists
    block = lambda n: F.pmod(F.xxhash64("vid", "vh"), F.col(n)).cast("int")
    group = lambda r, c: F.xxhash64("list", r, c)
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    candidates = index.join(sizes, "list").select(
        F.explode(F.transform(every("query_blocks"), lambda c: group(block("row_blocks"), c))).alias("group"), F.lit(True).alias("row"),
        "vid", "vh", "vector", "rotated", F.lit(0.0).alias("bar"))
    asking = probes.join(sizes, "list").select(
        F.explode(F.transform(every("row_blocks"), lambda r: group(r, block("query_blocks")))).alias("group"), F.lit(False).alias("row"),
        "vid", "vh", "vector", "rotated", "bar")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            flag = whole.column("row")
            rows, asked = whole.filter(flag), whole.filter(pc.invert(flag))
            if not rows.num_rows or not asked.num_rows:
                return
            x, xr, ids = _packed(rows, "vector"), _packed(rows, "rotated"), rows.column("vid").to_numpy()
            for a in range(0, asked.num_rows, 256):
                own = asked.slice(a, 256)
                q, r, score = scan(_packed(own, "vector"), _packed(own, "rotated"), x, xr, ids, own.column("bar").to_numpy(), k, search)
                yield pa.RecordBatch.from_arrays(
                    [own.column("vid").take(pa.array(q)), own.column("vh").take(pa.array(q)), rows.column("vid").take(pa.array(r)),
                     rows.column("vh").take(pa.array(r)), pa.array(score)], ["vid", "vh", "to_vid", "to_vh", "score"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            group = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and held[-1].column("group")[0].as_py() != group[a]:
                        yield from solved(held)
                        held = []
                    held.append(batch.slice(a, b - a))
        if held:
            yield from solved(held)

    return candidates.unionByName(asking).repartition("group").sortWithinPartitions("group").mapInArrow(
        run, "vid long, vh long, to_vid long, to_vh long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("vid", "vh").orderBy(F.desc("score"), "to_vid", "to_vh")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k).drop("nth")


def search_all(vectors: DataFrame, is_query: Column, search: Search = Search(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row of ``vectors`` that ``is_query`` (a condition on ``vec_id``)."""
    usable = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vector")).where(
        F.col("vec_id").isNotNull() & _usable(F.col("vector")))
    # a search for each dimension; a table has few, and ids of two dimensions are two queries
    dims = [r[0] for r in usable.select(F.size("vector").alias("dim")).distinct().orderBy("dim").collect()]
    if not dims:
        return usable.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    return reduce(DataFrame.unionByName, [_search_dimension(usable.where(F.size("vector") == dim), dim, is_query, search) for dim in dims])


def _search_dimension(usable: DataFrame, dim: int, is_query: Column, search: Search) -> DataFrame:
    k = search.k + 1  # one more, as a query's own row is among the candidates
    # a vector's entry: its smallest ids (k are enough for any query) under the smallest one
    of_vector = Window.partitionBy("vector").orderBy("vec_id")
    few = usable.distinct().withColumn("nth", F.row_number().over(of_vector)).where(F.col("nth") <= k)
    entries = stored(few.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.get("ids", F.lit(0)).alias("vid"), F.xxhash64("vector").alias("vh"), "ids", "vector"), "entries")
    asked = stored(usable.where(is_query).select(F.col("vec_id").alias("query_id"), "vector").distinct().join(
        entries.select("vid", "vh", "vector"), "vector").select("query_id", "vid", "vh"), "asked")
    reps = asked.select("vid", "vh").distinct().join(entries, ["vid", "vh"])

    n = entries.count()
    lists = int(np.clip(round(n ** 0.5 / 4), 1, search.max_lists))
    # the sample for training: the smallest hashes, at most max_lists * sample_per_list rows
    sample = entries.select("vector").orderBy(F.xxhash64("vid", "vh", F.lit(search.seed))).limit(lists * search.sample_per_list).toArrow()
    x = np.asarray(sample["vector"].combine_chunks().flatten(), np.float64).reshape(-1, dim)
    centroids, turn = train_lists(x, lists, search.seed), rotation(dim, search.seed)
    probes = max(1, int(np.ceil(len(centroids) * search.probe)))

    index = stored(_listed(entries, centroids, turn, 0), "index")
    probed = stored(_listed(reps, centroids, turn, probes), "probes")
    near = stored(_best(_scanned(index, probed.where("place = 0").withColumn("bar", F.lit(float("-inf"))), k, search), k), "near")
    bars = near.groupBy("vid", "vh").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("bar"))
    far = _scanned(index, probed.where("place > 0").join(bars, ["vid", "vh"]), k, search)
    best = _best(near.unionByName(far), k)
    members = entries.select(F.col("vid").alias("to_vid"), F.col("vh").alias("to_vh"), "ids")
    # k vectors times k ids at most; sorted by falling score, then id
    results = best.join(members, ["to_vid", "to_vh"]).select("vid", "vh", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("less"), i.alias("id")))).alias("r"))
    top = results.groupBy("vid", "vh").agg(F.sort_array(F.collect_list("r")).alias("all"))
    own = asked.join(top, ["vid", "vh"]).select("query_id", F.slice(F.filter("all", lambda r: r["id"] != F.col("query_id")), 1, search.k).alias("all"))
    return own.select("query_id", F.posexplode("all").alias("at", "r")).select(
        "query_id", (F.col("at") + 1).alias("rank"), F.col("r.id").alias("vec_id"), (-F.col("r.less")).alias("score"))
