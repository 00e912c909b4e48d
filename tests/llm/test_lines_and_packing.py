import hashlib
import itertools
import random

import numpy as np

from fareloom.llm import lines, packing
from fareloom.llm.common import WordHashes


def plain_blocks(docs):
    """The rule of the operator with dictionaries; ids and texts tell rows apart."""
    parts = [t.split("\n") if t else [] for _, t in docs]
    cuts = [lines.cuts([x.encode() for x in own], WordHashes()) for own in parts]
    keys = [hashlib.md5(((f"={i}" if i is not None else "-") + "\n" + (f"={t}" if t is not None else "-")).encode()).digest() for i, t in docs]
    places = {}
    for d, (doc_id, _) in enumerate(docs):
        for a, b in itertools.pairwise(cuts[d]):
            places.setdefault("\n".join(parts[d][a:b + 1]), []).append(((doc_id is not None, doc_id or 0, a, keys[d]), d, a, b))
    head = lambda d, a: parts[d][max((c for c in cuts[d] if c < a), default=0):a][::-1]
    tail = lambda d, b: parts[d][b + 1:min((c + 1 for c in cuts[d] if c > b), default=None)]
    shared = lambda x, y: len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(x, y))))
    drop, held = [set() for _ in docs], [set() for _ in docs]
    for found in places.values():
        if len(found) == 1:
            continue
        first, d1, a1, b1 = min(found, key=lambda f: f[0])
        for place, d, a, b in found:
            if place == first:
                held[d].update(range(a, b + 1))
                continue
            up = shared(head(d, a), head(d1, a1))
            down = shared(tail(d, b), tail(d1, b1))
            drop[d].update(range(a - up, b + down + 1))
    return [(i, "\n".join(x for k, x in enumerate(parts[d]) if k not in drop[d] - held[d]) if drop[d] - held[d] else t) for d, (i, t) in enumerate(docs)]


def corpus():
    rng = random.Random(11)
    passages = [[f"passage {p} line {i} {rng.random()}" for i in range(rng.randrange(2, 14))] for p in range(6)]
    docs = [(None, "\n".join(passages[0])), (0, None), (1, ""), (2, "one line"), (2, "one line"), (3, "\n\n\n"), (3, "\n".join(passages[1]) * 40)]
    for i in range(4, 60):
        own = []
        for _ in range(rng.randrange(1, 5)):
            own += rng.choice(passages) if rng.random() < 0.6 else [f"own {i} {rng.random()}" for _ in range(rng.randrange(1, 6))]
        docs.append((i, "\n".join(own)))
    return docs + [docs[10], docs[10]]


def test_boundaries_resist_shifts():
    rng = random.Random(1)
    text = [str(rng.random()).encode() for _ in range(200)]
    cut = lambda t: {tuple(t[a:b + 1]) for a, b in itertools.pairwise(lines.cuts(t, WordHashes()))}
    assert len(cut(text)) < 190 and min(map(len, cut(text))) == 2
    assert len(cut(text) & cut([b"new", *text[:100], b"other", *text[100:]])) >= len(cut(text)) - 4


def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = np.unique(rng.integers(0, 40, 8))
        counts = rng.integers(1, 30, len(lengths))
        pad = lambda ends: sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))
        best = min(pad((*some, lengths[-1])) for k in range(3) for some in itertools.combinations(lengths[:-1], k))
        found = packing.boundaries(lengths, counts, 3)
        assert len(found) <= 3 and pad(found) == best


def test_packing_is_whole_and_dense(spark):
    rng = random.Random(4)
    docs = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 50, 51, 700])))) for i in range(300)]
    docs += [(None, "a b"), (7, "a b"), (7, "a b"), (8, None)]
    shape = packing.Shape(max_length=64, buckets=4, token_budget=256)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, chunk int, batch string").repartition(5)
    rows = packing.pack(df, shape).collect()
    want = []
    for i, t in docs:
        n = len((t or "").split())
        want += [(i, k, min(64, n - 64 * k)) for k in range(max(1, -(-n // 64)))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.chunk, r.n_tokens)) for r in rows)
    for bucket in {r.bucket_length for r in rows}:
        own = sorted((r.batch, r.slot) for r in rows if r.bucket_length == bucket)
        size = max(1, 256 // max(1, bucket))
        assert own == [(i // size, i % size) for i in range(len(own))]
        in_order = [(r.doc_id is not None, r.doc_id or 0, r.chunk) for r in sorted((r for r in rows if r.bucket_length == bucket), key=lambda r: (r.batch, r.slot))]
        assert in_order == sorted(in_order)
    assert packing.pack(df.limit(0), shape).collect() == []


def blocks():
    """Blocks of two to six lines at three places each, between lines of their own."""
    docs = []
    for m in range(2, 7):
        for b in range(12):
            block = [f"block {m} {b} {i}" for i in range(m)]
            docs += [(100 + 50 * m + 3 * b + k, "\n".join([f"before {m} {b} {k}", *block[:1], *[""] * (b % 3), *block[1:], f"after {m} {b} {k}"])) for k in range(3)]
    return docs


def test_lines_equal_the_plain_rule(spark):
    docs = corpus() + blocks()
    df = spark.createDataFrame([(i, t, "x", 5, [1]) for i, t in docs], "doc_id long, text string, key string, n_lines int, spans array<int>").repartition(3)
    sort = lambda rows: sorted(rows, key=str)
    for chunking in (lines.Chunking(), lines.Chunking(window=1, share=0.5)):
        result = lines.remove_blocks(df, chunking)
        rows = result.collect()
        if chunking == lines.Chunking():
            assert sort((r.row.doc_id, r.new_text) for r in rows) == sort(plain_blocks(docs))
        assert all(r.n_removed == (r.row.text or "").count("\n") + bool(r.row.text) - (r.new_text or "").count("\n") - bool(r.new_text) for r in rows if r.new_text)
        # what goes has an equal line that stays
        assert {x for _, t in docs for x in (t or "").split("\n") if x} == {x for r in rows for x in (r.new_text or "").split("\n") if x}
    back = lines.rewritten(df, result)
    assert back.columns == df.columns and sort((r.doc_id, r.text) for r in back.collect()) == sort((r.row.doc_id, r.new_text) for r in rows)


def test_most_repeated_blocks_go_whole(spark):
    df = spark.createDataFrame(blocks(), "doc_id long, text string")
    left = [x for r in lines.remove_blocks(df).collect() for x in r.new_text.split("\n") if x.startswith("block ")]
    n = 12 * sum(range(2, 7))
    assert len(set(left)) == n and len(left) - n < 0.1 * 2 * n
    longest = [x for x in left if x.startswith("block 6")]
    assert len(longest) - len(set(longest)) < 0.05 * 2 * len(set(longest))  # a chunk of later places only stays at the first of them


def test_places_that_tie(spark):
    block = "one line of the block\nand the other"
    docs = [(None, "a\n" + block), (None, "b\n" + block), (7, "c\n" + block), (7, "d\n" + block), (7, "d\n" + block)]
    rows = lines.remove_blocks(spark.createDataFrame(docs, "doc_id long, text string"), lines.Chunking(1, 1.0)).collect()
    assert sum(block in r.new_text for r in rows) == 1 and all(r.row.doc_id is None for r in rows if block in r.new_text)
    same = lines.remove_blocks(spark.createDataFrame(docs[3:], "doc_id long, text string"), lines.Chunking(1, 1.0)).collect()
    assert [r.new_text for r in same] == ["d\n" + block] * 2  # equal rows count as one


def test_a_very_long_text_and_an_empty_table(spark):
    long = "\n".join(f"line {i % 40_000} of a long text" for i in range(80_000))
    df = spark.createDataFrame([(1, long), (2, None), (3, "")], "doc_id long, text string")
    rows = {r.row.doc_id: r for r in lines.remove_blocks(df).collect()}
    assert rows[1].n_lines == 80_000 and 39_990 <= rows[1].n_removed <= 40_000 and rows[1].new_text.startswith("line 0 of")
    assert rows[2].new_text is None and rows[3].new_text == "" and rows[2].n_removed == rows[3].n_removed == 0
    assert lines.remove_blocks(df.limit(0)).collect() == []
