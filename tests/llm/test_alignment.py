import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fareloom.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
EMPTY = (0, 0, 0, 0, 0, 0, "")


def alphabet():
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in kept}
    for b in range(256):
        if b not in kept:
            out[chr(256 + len(out) - len(kept))] = b
    return out


def brute(texts):
    """Whole texts by the libraries, every pair of tokens compared."""
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), alphabet()
    a.encode_special_tokens = True
    tokens = []
    for text in texts:
        if not text:
            tokens.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx = [bytes(letters[c] for c in a.id_to_token(i)) for i in x]
        by = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + text).encode()
        tokens.append((x, y, bx, by) if b"".join(bx) == whole and b"".join(by) == whole else None)
    links, shown = [], []
    for found in tokens:
        own, groups = [], []
        if found:
            x, y, bx, by = found
            ex, ey = np.cumsum([len(t) for t in bx]), np.cumsum([len(t) for t in by])
            sx, sy = ex - [len(t) for t in bx], ey - [len(t) for t in by]
            own = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if sx[i] < ey[j] and sy[j] < ex[i]]
            start = 0
            for end in sorted(set(ex) & set(ey)):
                groups.append(f"{','.join(str(x[i]) for i in range(len(x)) if start < ex[i] <= end)}|{','.join(str(y[j]) for j in range(len(y)) if start < ey[j] <= end)}")
                start = end
        links.append(own)
        shown.append(groups)
    count = Counter(p for own in links for p in set(own))
    highest = defaultdict(int)
    for (x, _), n in count.items():
        highest[x] = max(highest[x], n)
    return [(len(t[0]), len(t[1]), len(g), len(own), sum(count[p] == highest[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(";".join(g).encode()).hexdigest())
            if t else EMPTY for t, own, g in zip(tokens, links, shown)]


def samples():
    rng = random.Random(3)
    parts = ["the", "tokenization", " ", "  ", "\n", " \n", "\t", "don't", "we'll", "1234", "...", "日本", "é", "ü", "🙂", "　", "\x1c", "\x85", "\xa0", "<s>", "<unk>", "<0x41>",
             "<|endoftext|>", "Übergrößenträger", "x" * 40, "ﬁ", "ä̈", "‍", "'s", "_", "#*"]
    texts = ["", None, " ", "  ", "a", " a", "a ", "a  ", "\n", "\na", "a\n b", "a▁b", "▁", "x ▁ y z", "<|endoftext|>", "<s> </s>", "z" * 3000, "tie tie", "one two\n\n three   four "]
    return texts + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 14))) for _ in range(250)] + ["the same text again"] * 7


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_results_equal_brute_force(spark, limit):
    texts = samples()
    docs = spark.createDataFrame([(None if i == 5 else i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a string").repartition(3)
    want = sorted(((None if i == 5 else i, *r) for i, r in enumerate(brute(texts))), key=repr)
    assert sorted(map(tuple, alignment.align(docs, A, B, limit=limit).collect()), key=repr) == want
    assert sum(w[1:] == EMPTY for w in want) >= 4


def test_both_ways_agree_on_the_sample(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    one, other = alignment.align(docs, A, B), alignment.align(docs, A, B, limit=0)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    texts = [r.text for r in docs.orderBy("doc_id").select("text").limit(8).collect()]
    assert sorted(r[1:5] + r[7:] for r in map(tuple, one.collect()) if r[0] < 8) == sorted(w[:4] + w[6:] for w in brute(texts))


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_empty_tables(spark, limit):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, A, B, limit=limit).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, alignment.align(none, A, B, limit=limit).collect())) == [(1, *EMPTY), (2, *EMPTY)]


@pytest.mark.parametrize("n", [1, 2, 3, 50, 5000, 16384])
def test_the_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 50_000, n) << 32 | rng.integers(0, 32_000, n))
    seeds, placed = alignment.seeds_of(keys)
    slots = alignment.Slots([(0, seeds.tobytes(), placed.tobytes())], 1)
    assert sorted(slots.of(keys).tolist()) == list(range(len(keys)))
    with pytest.raises(ValueError):
        slots.of(np.array([1 << 60]))


def test_hash_in_buckets_and_tree_sum(spark, monkeypatch):
    monkeypatch.setattr(alignment, "KEYS", 100)
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    keys = (np.arange(1000, dtype=np.int64) * 7919) << 32 | np.arange(1000)
    index = alignment.build(spark.createDataFrame([(int(k),) for k in keys], "pair long"), 1000)
    slots = alignment.Slots([tuple(r) for r in index.collect()], 10)
    assert sorted(slots.of(keys).tolist()) == list(range(1000))
    vectors = spark.range(0, 40).select(F.lit(0).alias("bucket"), F.col("id").cast("int").alias("branch"))
    vectors = vectors.withColumn("counts", F.lit(np.array([1, 2, 3]).tobytes()))
    (row,) = alignment.tree_sum(vectors, 40).collect()
    assert np.frombuffer(row.counts, np.int64).tolist() == [40, 80, 120]
