import numpy as np
from pyspark.sql import functions as F

from fareloom.llm import nearest, queries
from fareloom.llm.common import read_table


def exact(rows, is_query, k):
    """Every pair, scored in order of the components."""
    good = list(dict.fromkeys((i, tuple(v)) for i, v in rows if i is not None and v and any(v) and all(x is not None and np.isfinite(x) for x in v)))
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good], np.float64)
    out = {}
    for i, v in zip(ids.tolist(), x):
        if is_query(i):
            score = np.add.accumulate(x * v, axis=1)[:, -1]
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def as_lists(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_recall_of_the_query(spark, sample):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, sample, "embeddings").collect()]
    want = exact(rows, lambda i: i % 20 == 0, 20)
    got = as_lists(queries.op2_nearest_neighbours(spark, sample).collect())
    assert got.keys() == want.keys() and all(len(v) == len(want[q]) for q, v in got.items())
    hits = sum(len(dict(v).keys() & dict(want[q]).keys()) for q, v in got.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    scores = {q: dict(v) for q, v in exact(rows, lambda i: i % 20 == 0, len(rows)).items()}
    assert all(scores[q][i] == s for q, v in got.items() for i, s in v)


def test_all_lists_without_doubt_are_exact(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.standard_normal((700, 12)) * rng.uniform(0.5, 3, (700, 1)), 1)
    x[100:400] = x[5]  # many copies
    rows = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(5, x[5].tolist()), (900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12),
                                                             (904, [None] * 12), (905, [1.0] * 3), (None, [1.0] * 12)]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    search = nearest.Search(k=7, probe=1.0, doubt=1e6, rows=50, queries=3)
    got = as_lists(nearest.search_all(df, F.col("vec_id") % 20 == 0, search).collect())
    assert got == exact([r for r in rows if r[0] != 905], lambda i: i % 20 == 0, 7)
    few = as_lists(nearest.search_all(df.where("vec_id < 3"), F.col("vec_id") >= 0, search).collect())
    assert {q: len(v) for q, v in few.items()} == {0: 2, 1: 2, 2: 2}
    assert nearest.search_all(df.where("vec_id = 902"), F.col("vec_id") % 2 == 0).collect() == []


def test_each_dimension_is_searched_among_its_own(spark):
    rng = np.random.default_rng(4)
    wide = [(int(i), np.round(v, 2).tolist()) for i, v in enumerate(rng.standard_normal((60, 3)))]
    flat = [(100, [1.0, 2.0]), (101, [0.5, -1.0]), (20, [3.0, 1.0]), (140, None)]
    alone = [(200, [4.0])]
    df = spark.createDataFrame(wide + flat + alone, "vec_id long, embedding array<double>").repartition(3)
    search = nearest.Search(k=5, probe=1.0, doubt=1e6)
    rows = nearest.search_all(df, F.col("vec_id") % 20 == 0, search).collect()
    two = exact(flat, lambda i: i % 20 == 0, 5)
    got = sorted((r.query_id, r.vec_id, r.score) for r in rows)
    want = [(q, i, s) for part in (exact(wide, lambda i: i % 20 == 0, 5), two) for q, found in part.items() for i, s in found]
    assert got == sorted(want) and [i for i, _ in two[100]] == [20, 101]


def test_lists_are_trained_in_blocks():
    x = np.random.default_rng(2).standard_normal((257, 6))
    assert (nearest.nearest_list(x, x[:9], 10) == nearest.nearest_list(x, x[:9], 1000)).all()


def test_rejected_candidates_are_far():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 64))
    turn = nearest.rotation(64, 3)
    assert np.allclose(turn @ turn.T, np.eye(64))
    search = nearest.Search()
    q, r, score = nearest.scan(x[:40], x[:40] @ turn.T, x, x @ turn.T, np.arange(3000), np.full(40, -np.inf), 10, search)
    want = np.argsort(-(x[:40] @ x.T), axis=1)[:, :10]
    hits = sum(len(set(r[q == i].tolist()) & set(want[i].tolist())) for i in range(40))
    assert hits >= 390
