import random
import re

import pytest

from fareloom.llm import components, jaccard, queries
from fareloom.llm.common import read_table


def shingles(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(docs):
    """All pairs that share a shingle, then union-find."""
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        seen = set()
        for x in s:
            for j in holders.get(x, []):
                if j not in seen:
                    seen.add(j)
                    if 100 * len(s & sets[j]) >= 75 * len(s | sets[j]):
                        root[find(i)] = find(j)
            holders.setdefault(x, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(docs, sets)))


def corpus():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdEFé") for _ in range(rng.randrange(1, 6)))
    passage = [word() for _ in range(30)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "Two words"), (4, "two  WORDS"), (5, "a b c d e"), (6, "a b c d e f"), (7, "É b c d e"), (8, "é b c d e")]
    for base in range(12):
        own = [word() for _ in range(rng.randrange(6, 150))] + (passage if base % 2 else [])
        for _ in range(rng.randrange(1, 12)):
            docs.append((len(docs), " ".join(own)))
            own = list(own)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = word()
    docs += [(len(docs) + i, " ".join([*passage, *[word() for _ in range(7)]])) for i in range(40)]
    return docs + [docs[30], docs[31], (None, docs[12][1]), (None, "only here with words of no id"), (None, None)]


@pytest.mark.parametrize("small", [False, True])
def test_join_equals_brute_force(spark, small):
    join = jaccard.Join(tile=3, part=2, shard_bytes=1 << 10, shard_rows=64) if small else jaccard.Join()
    docs = corpus()
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, tid string").repartition(3)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join_texts(df, join).collect())
    want = plain_components(docs)
    assert got == want
    assert len({c for _, _, c in want}) < len(docs) - 20


def test_many_more_shards_than_shingles(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    total = sum(len((t or "").encode()) for _, t in docs)
    join = jaccard.Join(shard_bytes=total / (1 << 20))  # 1 << 20 shards or more
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join_texts(df, join).collect())
    assert got == plain_components(docs)


def test_a_shingle_of_many_parts(spark):
    """All texts hold one shingle of a common start; two families of copies with small edits, and texts apart."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    common = [word() for _ in range(6)]
    docs = []
    for _ in range(2):
        own = [word() for _ in range(60)]
        for _ in range(25):
            edited = list(own)
            edited[rng.randrange(60)] = word()
            docs.append((len(docs), " ".join(common + edited)))
    docs += [(len(docs) + i, " ".join([*common, *[word() for _ in range(58)]])) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for tile in (4, 16):
        got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard.join_texts(df, jaccard.Join(tile=tile, part=4)).collect())
        assert got == plain_components(docs)


def test_query_equals_brute_force(spark, sample):
    docs = [(r.doc_id, r.text) for r in read_table(spark, sample, "documents").select("doc_id", "text").collect()]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in queries.op4_ngram_jaccard(spark, sample).collect())
    assert got == plain_components(docs)


def test_no_links_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.join_texts(df).collect()) == [(1, 1), (2, 2)]
    assert jaccard.join_texts(df.limit(0)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(40)] + [(100, rng.randrange(101, 160)) for _ in range(50)] + [(200, 300), (300, 250), (7, 7)]
    df = spark.createDataFrame(edges, "x long, y long")
    roots = {r.node: r.root for r in components.components(df, "x", "y").collect()}
    assert all(roots[i] == 0 for i in range(41)) and roots[300] == roots[250] == 200
    assert all(roots[b] == 100 for a, b in edges if a == 100)
