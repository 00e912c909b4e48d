import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from fareloom.llm import queries, substrings, suffixes, windows
from fareloom.llm.common import read_table


def plain_marks(sequences, size):
    """Which items of each sequence lie in a window that starts at two places."""
    seen = Counter(s[i:i + size] for s in sequences for i in range(len(s) - size + 1))
    out = []
    for s in sequences:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - size + 1):
            if seen[s[i:i + size]] > 1:
                gone[i:i + size] = True
        out.append(gone)
    return out


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(20, 90))) for _ in range(5)]
    docs = [None, "", "   ", "a" * 900, "ab " * 300, passages[0] * 3, "x"]
    for _ in range(80):
        docs.append("  \n".join(rng.choice(passages) if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 60)))
                                for _ in range(rng.randrange(1, 6))))
    docs += [docs[20]] * 3
    near = docs[30].split()
    near[len(near) // 2] = "changed"
    return [*docs, " ".join(near), "\x00" * 50 + "b" * 50 + "\x00" * 90]


@pytest.mark.parametrize("hot", [2048, 1])
def test_both_removers_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(windows.Windows.__init__, "__defaults__", (hot,))
    docs = [(i if i != 9 else None, t, "x") for i, t in enumerate(texts())]
    docs += [docs[8], docs[40]]
    df = spark.createDataFrame(docs, "doc_id long, text string, row_key string").repartition(4)
    for module, size, split, join in ((suffixes, 60, lambda t: t.encode(), lambda own: bytes(own)),
                                      (substrings, 10, lambda t: tuple(t.encode().split()), lambda own: b" ".join(own))):
        marks = plain_marks([split(t or "") for _, t, _ in docs], size)
        assert 0 < sum(map(np.any, marks)) < len(docs)
        want = sorted((str(i), t or "", int(m.sum()), join([x for x, gone in zip(split(t or ""), m) if not gone]))
                      for (i, t, _), m in zip(docs, marks) if m.any())
        key = windows.row_key()
        rows = df.select("doc_id", "text", key.alias("k")).join(module.removed(df, size).withColumnRenamed("row_key", "k"), "k").collect()
        got = sorted((str(r.doc_id), r.text or "", r.n_removed, bytes(r.kept)) for r in rows)
        assert got == want
        whole = module.remove(df, size)
        assert whole.columns == df.columns and whole.count() == len(docs)
        assert module.remove(df.limit(0), size).collect() == []


def test_queries_equal_brute_force(spark, sample):
    docs = [(r.doc_id, (r.text or "").encode()) for r in read_table(spark, sample, "documents").select("doc_id", "text").collect()]
    marks = plain_marks([t for _, t in docs], 400)
    rest = {i: np.frombuffer(t, np.uint8)[~m].tobytes() for (i, t), m in zip(docs, marks)}
    for r in queries.op6_suffix_array_dedup(spark, sample).collect():
        assert r.kept_sha256 == hashlib.sha256(rest[r.doc_id]).hexdigest()
    words = [tuple(t.split()) for _, t in docs]
    marks = plain_marks(words, 35)
    want = {i: (len(w), int(m.sum()), hashlib.sha256(b" ".join(x for x, gone in zip(w, m) if not gone)).hexdigest())
            for (i, _), w, m in zip(docs, words, marks)}
    rows = queries.op7_substring_dedup(spark, sample).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == want


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for trial in range(200):
        b = bytes(rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(1, 60)))
        t = np.concatenate([np.frombuffer(b, np.uint8).astype(np.int64) + 1, [0]])
        want = sorted(range(len(t)), key=lambda i: tuple(t[i:]))
        assert suffixes.suffix_array(t, 257).tolist() == want
        small = suffixes._smaller(t)
        lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        order = np.array([i for i in want if i in set(lms.tolist())])
        assert suffixes._induce_by_scan(t, small, 257, order).tolist() == want
        sa = np.array(want[1:])
        common = suffixes.permuted_prefixes(np.frombuffer(b, np.uint8), sa)
        for a, c in zip(sa, sa[1:]):
            x, y = b[a:], b[c:]
            assert common[c] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_prefix_groups_and_nodes():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 500)
    starts = np.arange(480)
    groups = list(substrings.prefix_groups(words, starts, 20, 16))
    assert sorted(np.concatenate(groups).tolist()) == starts.tolist()
    where = {}
    for g, group in enumerate(groups):
        for s in group.tolist():
            assert where.setdefault(tuple(words[s:s + 20]), g) == g
    assert sorted(substrings.internal_nodes([1, 3, 3, 0, 2])) == [(1, 0, 3), (2, 4, 5), (3, 1, 3)]


@pytest.mark.parametrize("module, size, gram", [(suffixes, 60, 9), (substrings, 10, 3)])
def test_a_hot_key_is_never_gathered(spark, module, size, gram):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    own = lambda: " ".join(word() for _ in range(20))
    passage = " ".join(word() for _ in range(16))
    docs = [f"{own()} {passage} {own()}" for _ in range(60)] + ["q " * 90, passage, passage]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    items = module._bytes_of if module is suffixes else module._words_of
    plain = module.repeated_windows

    def guarded(segments, times, n):
        if len(segments) > 8:
            raise ValueError(f"{len(segments)} segments of one key in one task")
        return plain(segments, times, n, size)

    found = windows.touched(df, items, guarded, windows.Windows(size, gram, size * 4 // 5, hot=8), shard_bytes=1)
    split = (lambda t: t.encode()) if module is suffixes else (lambda t: tuple(t.split()))
    want = {t: m.tolist() for t, m in zip(docs, plain_marks([split(t) for t in docs], size)) if m.any()}
    got = {bytes(r.text).decode(): windows.covered(len(split(bytes(r.text).decode())), r.spans, size).tolist() for r in found.collect()}
    assert got == want and len(got) > 60


def test_suffix_arrays_of_bytes_never_scan_in_python(monkeypatch):
    """Long repeats, whose order took several levels of a scan by single characters."""
    def fails(*_):
        raise AssertionError("a scan by single characters")

    monkeypatch.setattr(suffixes, "_induce_by_scan", fails)
    rng = random.Random(3)
    passage = bytes(rng.choice(b"abc ") for _ in range(700))
    texts_ = [passage * 3, passage[5:] + b"x" + passage, b"\0".join([passage] * 2), b"ab" * 400, b"a" * 300, b"abc" * 99 + b"abd" * 99, b"", b"b"]
    texts_ += [bytes(rng.choice(b"ab") for _ in range(n)) for n in (2, 3, 17, 900)]
    for b in texts_:
        t = np.append(np.frombuffer(b, np.uint8).astype(np.int64) + 1, 0)
        assert suffixes.suffix_array(t, 257).tolist() == [len(b), *sorted(range(len(b)), key=lambda i: b[i:])]
    ranks = np.array([2, 0, 2, 0, 2, 0]) + 1  # a string whose least character stands at its end only
    ranks[-1] = 0
    assert suffixes._ordered(ranks).tolist() == sorted(range(6), key=lambda i: ranks[i:].tolist())


def test_op6_takes_passages_of_over_50_words_from_400_bytes_on(spark, tmp_path):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    docs, want = [], {}
    for size in (357, 399, 400, 401, 600):
        passage = text(90)[:size]
        assert len(passage.split()) > 50
        for before, after in ("<>", "[]"):  # what stands beside the passage differs, so no more than it repeats
            head, tail = f"{text(80)} {before}", f"{after} {text(80)}"
            gone = size >= 400
            rest = head + tail if gone else head + passage + tail
            want[len(docs)] = (len(head + passage + tail), size * gone, int(gone), hashlib.sha256(rest.encode()).hexdigest())
            docs.append(head + passage + tail)
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op6_suffix_array_dedup(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(queries.BYTES_SQL).fetchall()} == want
