import itertools
import random
from collections import Counter as Count

import numpy as np

from fareloom.llm import language, unigram
from fareloom.llm.common import read_table


def test_held_out_accuracy(spark, sample):
    docs = read_table(spark, sample, "documents")
    held = language.held_out("doc_id")
    langs, weights = language.matrix(language.train(docs.where(~held)))
    assert langs == ["de", "en", "es", "fr"]
    rows = language.predict(docs.where(held), langs, weights).join(docs.select("doc_id", "lang"), "doc_id").collect()
    right = sum(r.lang == r.lang_pred for r in rows)
    assert right >= 0.9 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_counts_equal_a_plain_count(spark):
    texts = [("a", "Abc ab"), ("b", "xyz"), ("a", ""), (None, "abc"), ("b", None)]
    docs = spark.createDataFrame(texts, "lang string, text string")
    got = {lang: 0 for lang in "ab"}
    for r in language.train(docs).collect():
        got[r.lang] += r.n
    plain = lambda t: sum(max(0, len(t) + 2 - n + 1) for n in (1, 2, 3))
    assert got == {"a": plain("Abc ab") + plain(""), "b": plain("xyz")}


def test_undecided_and_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "abc"), (None, "abc"), (4, "abc")], "doc_id long, text string")
    langs, weights = language.matrix(language.train(spark.createDataFrame([("x", "abc"), ("y", "abc")], "lang string, text string")))
    rows = [(r.doc_id, r.lang_pred) for r in language.predict(docs, langs, weights).collect()]
    assert rows == [(1, "und"), (2, "und"), (3, "und"), (4, "x"), (None, "x"), (4, "x")]
    none, empty = language.matrix(language.train(docs.selectExpr("cast(null as string) lang", "text")))
    assert none == [] and {r.lang_pred for r in language.predict(docs, none, empty).collect()} == {"und"}


def best_count(word, scores):
    """All segmentations, one by one."""
    found = []
    for cuts in itertools.product([0, 1], repeat=max(0, len(word) - 1)):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(word)]
        parts = [word[a:b] for a, b in zip(at, at[1:])]
        if all(p in scores for p in parts):
            found.append((-sum(scores[p] for p in parts), len(parts)))
    least = min(x for x, _ in found)
    return min(n for x, n in found if x <= least + 1e-9)


def test_token_counts_equal_brute_force(spark):
    rng = random.Random(3)
    scores = {bytes([b]): -12.0 for b in range(256)}
    for _ in range(120):
        scores[bytes(rng.choice(b"abc ") for _ in range(rng.randrange(2, 6)))] = -float(rng.randrange(3, 40))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 11))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t + " " + t[::-1][:5], "z") for i, t in enumerate(texts)] + [(-1, None, "z"), (-2, "", "z")],
                                 "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in unigram.token_counts(docs, scores).collect()}
    assert got[-1] == got[-2] == 0
    for i, t in enumerate(texts):
        assert got[i] == best_count(t.encode(), scores) + best_count((" " + t[::-1][:5]).encode(), scores)


def test_shared_prefixes_do_not_change_counts():
    scores = {bytes([b]): -9.0 for b in range(256)} | {b"ab": -3.0, b"abc": -4.0, b"bc": -1.0}
    together = unigram.Counter(scores)
    words = [b"abcab", b"abc", b"ab", b"abcb", b"b", b"bcab", b"c" * 300]
    together.count(words)
    for w in words:
        alone = unigram.Counter(scores)
        alone.count([w])
        assert alone.new[w] == together.new[w]
    assert Count(map(len, words)) and np.isfinite(max(scores.values()))
