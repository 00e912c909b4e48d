"""Alignment of two tokenizers, with corpus-wide counts of linked token pairs.

Two tokenizations of a text are laid over one another by bytes: places where tokens of both
end cut them into groups, and between two neighbouring ends, of whichever kind, lies one link.
The first pass aligns all documents; tasks count their pairs of linked ids. Every distinct
pair gets a slot by a minimal perfect hash, built bucket by bucket in tasks. By their slots
the counts become dense vectors, which are summed as a tree. The second pass aligns the
documents again and looks the counts up; a slot holds its pair, by which each look-up is
verified.

Neither tokenizer joins a blank to what stands before it, so texts are aligned chunk by chunk,
a chunk beginning with a blank after something else, and a worker keeps the chunks it has
seen. A text with a chunk that its tokens do not spell is aligned as one chunk.

The hash is sent to all tasks only while it has at most ``limit`` bytes (there are never more
pairs than the product of the vocabularies). Beyond, blocks of documents ask for the counts
of their pairs by a join.

Defined cases: a null or empty text, or one that the tokens of either kind do not spell, has
no tokens, zeros and an empty group digest, and adds to no count; equal rows count each and
get equal results; null ids stay; an empty table gives an empty result; further columns are
not read; a text without blanks is one chunk, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fareloom.llm.bpe import PATTERN, byte_alphabet
from fareloom.llm.common import mixed, ragged_ranges, ragged_starts, slices, stored

KEYS = 1 << 14  # keys in a bucket of the hash, on average
FEW = 3  # keys that share a seed, on average
TRIED = 128  # seeds tried at once
FAN_IN = 32  # vectors that one node of the summing tree adds


class Numbers(dict):
    """Numbers in order of first sight; ``new`` holds what has none of the rest yet."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def of(self, keys: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, keys), np.int64, len(keys))


class Aligner:
    """Both tokenizers, and the chunks seen lately: their numbers of tokens, groups and links,
    their links as numbers of pairs, and their groups as text if ``show``.

    The byte-level tokenizer runs by ranks instead of merge rules; both give the same tokens
    where each merge makes the next id, which is checked.
    """

    room, room_chars = 400_000, 32 << 20  # chunks and characters kept; only speed depends on it

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken

        spec, alphabet = json.loads(a), byte_alphabet()
        vocab = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if all(c in alphabet for c in token)}
        special = {t["content"] for t in spec["added_tokens"]}
        ranks = {token: i for token, i in vocab.items() if token.decode("utf-8", "replace") not in special}
        merged = [spec["model"]["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            raise ValueError("the merges of the first tokenizer are not in the order of its ids")
        self.ids_a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.size_a = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.size_a[i] = len(token)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of the second tokenizer span blanks")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_b = np.array(list(map(len, self.bytes_b)))
        self.blank = self.b.piece_to_id("▁")
        self.told_a, self.told_b = (np.array([[b"%d%s" % (i, mark) for i in range(n)] for mark in marks], object)
                                    for n, marks in ((len(self.size_a), (b",", b"|")), (len(self.size_b), (b",", b";"))))
        self.inner = re.compile(r"\s ").search
        self.cut = re.compile(r"(?<=\S) ").split
        self.show = False
        self.clear()

    def clear(self) -> None:
        self.chunks, self.pair_numbers, self.chars = Numbers(), Numbers(), 0
        self.spelled = np.empty(0, bool)
        self.sizes = np.empty((0, 4), np.int64)  # tokens of both kinds, groups, links
        self.link_at, self.links = np.zeros(1, np.int64), np.empty(0, np.int64)
        self.pairs = np.empty(0, np.int64)  # ids as a << 32 | b
        self.shown: list[bytes] = []

    def full(self) -> bool:
        return len(self.chunks) >= self.room or self.chars >= self.room_chars

    def _learn(self) -> None:
        """Aligns the new chunks; a chunk is given without the blank before it."""
        words, self.chunks.new = self.chunks.new, []
        if not words:
            return
        self.chars += sum(map(len, words))
        n, told = len(words), [f" {w}".encode() for w in words]
        a, na = self._ids_a(words, np.array(list(map(len, told))))
        ids = self.b.encode(words, num_threads=1)
        if "" in words:  # the tokenizer puts no blank before an empty text
            ids[words.index("")] = [self.blank]
        nb = np.array(list(map(len, ids)))
        b = np.fromiter(chain.from_iterable(ids), np.int64, int(nb.sum()))
        spelled = np.ones(n, bool)
        pieces = list(map(self.bytes_b.__getitem__, b.tolist()))
        if b"".join(pieces) != b"".join(told) or (np.add.reduceat(self.size_b[b], ragged_starts(nb)[:-1]) != list(map(len, told))).any():
            at = ragged_starts(nb).tolist()
            spelled = np.array([b"".join(pieces[p:q]) == t for p, q, t in zip(at, at[1:], told)])
        of_a, of_b = np.repeat(np.arange(n), na), np.repeat(np.arange(n), nb)
        a, b, of_a = a[spelled[of_a]], b[spelled[of_b]], of_a[spelled[of_a]]
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        ends = np.concatenate([end_a, end_b])
        ends.sort(kind="stable")  # two sorted runs are merged
        ends = ends[np.diff(ends, append=-1) != 0]
        i, j = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        both = (end_a[i] == ends) & (end_b[j] == ends)
        n_links, n_groups = np.bincount(of_a[i], minlength=n), np.bincount(of_a[i[both]], minlength=n)
        distinct, back = np.unique(a[i] << 32 | b[j], return_inverse=True)
        numbers = self.pair_numbers.of(distinct.tolist())
        self.pairs = np.concatenate([self.pairs, np.array(self.pair_numbers.new, np.int64)])
        self.pair_numbers.new = []
        self.spelled = np.concatenate([self.spelled, spelled])
        self.sizes = np.concatenate([self.sizes, np.where(spelled, [na, nb, n_groups, n_links], 0).T])
        self.links = np.concatenate([self.links, numbers[back]])
        self.link_at = np.concatenate([self.link_at, self.link_at[-1] + np.cumsum(n_links)])
        if self.show:
            self._show(a, b, i[both], j[both], np.where(spelled, na + nb, 0))

    def _ids_a(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of blank + word for each word, one after another, and their numbers.

        Words that end with white space, or are empty, would join with the next blank, so
        they are encoded alone; the others are encoded as one text and told apart by bytes.
        """
        alone = [k for k, w in enumerate(words) if not w or w[-1].isspace()]
        apart = set(alone)
        ids = np.array(self.ids_a("".join([f" {w}" for k, w in enumerate(words) if k not in apart] if alone else [f" {w}" for w in words])), np.int64)
        ends = np.cumsum(np.delete(sizes, alone))
        stops = np.searchsorted(np.cumsum(self.size_a[ids]), ends, side="right")
        counts = np.diff(stops, prepend=0)
        if not alone:
            return ids, counts
        found = iter(np.split(ids, stops[:-1]) if len(stops) else [])
        each = [np.array(self.ids_a(f" {w}"), np.int64) if k in apart else next(found) for k, w in enumerate(words)]
        return np.concatenate(each), np.array(list(map(len, each)))

    def _show(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, n_tokens: np.ndarray) -> None:
        """Each chunk's groups as text, with a semicolon at the end; ``last``: the last tokens of groups."""
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        start_a, start_b = np.concatenate([[0], last_a + 1]), np.concatenate([[0], last_b + 1])
        group_a, group_b = np.cumsum(end_a) - end_a, np.cumsum(end_b) - end_b
        order = np.empty(len(a) + len(b), object)  # of a group, first the tokens of one kind, then of the other
        order[np.arange(len(a)) + start_b[group_a]] = self.told_a[end_a, a]
        order[np.arange(len(b)) + start_a[group_b + 1]] = self.told_b[end_b, b]
        parts, at = order.tolist(), ragged_starts(n_tokens).tolist()
        self.shown += [b"".join(parts[p:q]) for p, q in zip(at, at[1:])]

    def _chunks(self, text: str) -> list[str]:
        """Chunks without the blank before them."""
        if text[0] != " " and not self.inner(text):
            return text.split(" ")
        first, *rest = self.cut(" " + text)
        return [first[1:], *rest]

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(chunk numbers, the place at which each text's begin): none for a text without tokens."""
        if self.full():
            self.clear()
        words = [self._chunks(t) if t else [] for t in texts]
        numbers = self.chunks.of([w for own in words for w in own])
        self._learn()
        at = ragged_starts(np.array(list(map(len, words)), np.int64))
        odd = np.unique(np.searchsorted(at, np.flatnonzero(~self.spelled[numbers]), side="right") - 1)
        if len(odd):
            whole = dict(zip(odd.tolist(), self.chunks.of([texts[k] for k in odd])))
            self._learn()
            parts = [([whole[k]] if self.spelled[whole[k]] else []) if k in whole else numbers[at[k]:at[k + 1]] for k in range(len(texts))]
            numbers, at = np.concatenate([np.asarray(p, np.int64) for p in parts]), ragged_starts(np.array(list(map(len, parts)), np.int64))
        return numbers, at

    def holders(self, numbers: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each pair number, how many of the texts hold the pair."""
        def once(text: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = np.unique(text << 32 | number)
            return keys >> 32, keys & 0xFFFFFFFF

        text, chunk = once(np.repeat(np.arange(len(at) - 1), np.diff(at)), numbers)
        n = self.sizes[chunk, 3]
        _, pair = once(np.repeat(text, n), self.links[ragged_ranges(self.link_at[chunk], n)])
        return np.bincount(pair, minlength=len(self.pairs))


_KEPT: dict[int, Aligner] = {}


def _aligner(shared, show: bool = False) -> Aligner:
    """The worker's aligner; later tasks find it with the chunks of earlier ones."""
    key = zlib.crc32(shared.value[0]) << 32 | zlib.crc32(shared.value[1])
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = Aligner(*shared.value)
    if show and not _KEPT[key].show:
        _KEPT[key].show = True
        _KEPT[key].clear()
    return _KEPT[key]


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        raw = f.read()
    if len(raw) > 64 << 20:
        raise ValueError(f"{path}: too large for a vocabulary")
    return raw


def _texts(batches: Iterator[pa.RecordBatch], column: int = 1) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    for part in slices(batches, column, 4 << 20):
        yield part, part.column(column).cast(pa.string()).to_pylist()


def pair_counts(texts: DataFrame, tokenizers) -> DataFrame:
    """The first pass. ``task, pair, n``: in how many of a task's texts a pair is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, task = _aligner(tokenizers), TaskContext.get().partitionId()
        total = np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            held = np.flatnonzero(total)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(held), task), pa.int32()), pa.array(aligner.pairs[held]), pa.array(total[held])], ["task", "pair", "n"])

        for _, body in _texts(batches):
            if aligner.full():  # pairs get new numbers
                yield told()
                total = np.zeros(0, np.int64)
            found = aligner.holders(*aligner.read(body))
            found[:len(total)] += total
            total = found
        yield told()

    return texts.mapInArrow(run, "task int, pair long, n long")


def _hash(pair: np.ndarray) -> np.ndarray:
    return mixed(pair.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _sub(h: np.ndarray, n_seeds: np.ndarray | int) -> np.ndarray:
    """Which of a bucket's seeds is a key's."""
    return (mixed(h ^ np.uint64(0xC2B2AE3D27D4EB4F)) % np.asarray(n_seeds, np.uint64)).astype(np.int64)


def _place(h: np.ndarray, seed: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """The slot a seed gives; a negative seed is a slot itself."""
    seed = np.asarray(seed, np.int64)
    tried = mixed(h + seed.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.asarray(n, np.uint64)
    return np.where(seed < 0, -seed - 1, tried.astype(np.int64))


def seeds_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, keys in slot order) of a minimal perfect hash over distinct keys.

    Keys that share a seed are placed together, the largest groups first: the first seed that
    puts all of them into free slots. A key alone takes any free slot, named by its seed.
    """
    n = len(keys)
    h = _hash(keys)
    seeds = np.zeros(-(-n // FEW), np.int32)
    group = _sub(h, len(seeds))
    order = np.argsort(group, kind="stable")
    bounds = ragged_starts(np.bincount(group, minlength=len(seeds)))
    slots, free = np.full(n, -1, np.int64), np.ones(n, bool)
    sizes = np.diff(bounds)
    for g in np.argsort(-sizes, kind="stable"):
        members = order[bounds[g]:bounds[g + 1]]
        if len(members) < 2:
            break
        first = 0
        while True:
            tried = np.arange(first, first + TRIED)
            place = np.sort(_place(h[members][None, :], tried[:, None], n), axis=1)
            fits = np.flatnonzero(free[place].all(axis=1) & (place[:, 1:] != place[:, :-1]).all(axis=1))
            if len(fits):
                break
            first += TRIED
        seeds[g] = first + fits[0]
        slots[members] = _place(h[members], int(seeds[g]), n)
        free[slots[members]] = False
    for g, place in zip(np.flatnonzero(sizes == 1), np.flatnonzero(free)):
        seeds[g], slots[order[bounds[g]]] = -place - 1, place
    placed = np.empty(n, np.int64)
    placed[slots] = keys
    return seeds, placed


def build(found: DataFrame, n_pairs: int) -> DataFrame:
    """``bucket, seeds, keys``: the hash, a bucket of keys a row (keys in slot order)."""
    n_buckets = max(1, n_pairs // KEYS)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = np.asarray(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(pair, n_buckets), pa.int32()), batch.column(0)], ["bucket", "pair"])

    def one(key: tuple, table: pa.Table) -> pa.Table:
        seeds, keys = seeds_of(np.sort(np.asarray(table.column("pair"))))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "seeds": pa.array([seeds.tobytes()], pa.binary()), "keys": pa.array([keys.tobytes()], pa.binary())})

    return found.mapInArrow(number, "bucket int, pair long").groupBy("bucket").applyInArrow(one, "bucket int, seeds binary, keys binary")


def bucket_of(pair: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mixed(_hash(pair)) % np.uint64(n_buckets)).astype(np.int32)


class Slots:
    """The whole hash: slots of pairs, verified by the pairs the slots hold."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], n_buckets: int):
        seeds, keys = [np.empty(0, np.int32)] * n_buckets, [np.empty(0, np.int64)] * n_buckets
        for bucket, s, k in rows:
            seeds[bucket], keys[bucket] = np.frombuffer(s, np.int32), np.frombuffer(k, np.int64)
        self.n_buckets = n_buckets
        self.seed_at, self.key_at = ragged_starts(np.array([len(x) for x in seeds])), ragged_starts(np.array([len(x) for x in keys]))
        self.seeds, self.keys = np.concatenate(seeds), np.concatenate(keys)

    def of(self, pair: np.ndarray) -> np.ndarray:
        if not len(pair):
            return np.empty(0, np.int64)
        h, bucket = _hash(pair), bucket_of(pair, self.n_buckets)
        n_seeds, n_keys = (np.diff(at)[bucket] for at in (self.seed_at, self.key_at))
        seed = self.seeds[self.seed_at[bucket] + _sub(h, n_seeds)]
        slot = self.key_at[bucket] + _place(h, seed, n_keys)
        if not np.array_equal(self.keys[slot], pair):
            raise ValueError("a pair is not in the hash")
        return slot


def tree_sum(vectors: DataFrame, branches: int) -> DataFrame:
    """``bucket, counts``: the dense vectors of each bucket added up, ``FAN_IN`` at a time.

    ``vectors``: bucket, branch, counts, at most one vector for each bucket and branch below
    ``branches``. No task ever holds more than ``FAN_IN`` vectors of a bucket.
    """
    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), np.int64) for v in table.column("counts"))
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "branch": pa.array([key[1].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    while branches > 1:
        branches = -(-branches // FAN_IN)
        vectors = vectors.withColumn("branch", F.floor(F.col("branch") / FAN_IN).cast("int")).groupBy("bucket", "branch").applyInArrow(add, vectors.schema)
    return vectors.select("bucket", "counts")


def counted(counts: DataFrame, slots) -> DataFrame:
    """``bucket, counts``: for each slot, how many texts hold its pair linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash_ = slots.value
        total = np.zeros(len(hash_.keys), np.int64)
        for batch in batches:
            np.add.at(total, hash_.of(np.asarray(batch.column(0))), np.asarray(batch.column(1)))
        bounds, task = hash_.key_at.tolist(), TaskContext.get().partitionId()
        for bucket, (start, end) in enumerate(zip(bounds, bounds[1:])):  # one bucket's vector at a time
            if total[start:end].any():
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([task], pa.int32()), pa.array([total[start:end].tobytes()], pa.binary())],
                                                 ["bucket", "branch", "counts"])

    vectors = stored(counts.select("pair", "n").mapInArrow(run, "bucket int, branch int, counts binary"), "vectors")
    most = vectors.agg(F.max("branch")).first()[0]
    return tree_sum(vectors, 1 if most is None else most + 1)


RESULT = StructType([*[StructField(c, LongType()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], StructField("groups_sha256", StringType())])


def _results(aligner: Aligner, texts: list[str | None], look_up: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> list[pa.Array]:
    """The result columns of some texts; ``look_up`` gives pairs' counts and whether they are their first id's highest."""
    numbers, at = aligner.read(texts)
    used, place = np.unique(numbers, return_inverse=True)
    n = aligner.sizes[used, 3]
    links = aligner.links[ragged_ranges(aligner.link_at[used], n)]
    pair, back = np.unique(links, return_inverse=True)
    count, best = (np.asarray(x, np.int64)[back] for x in look_up(aligner.pairs[pair]))
    link_at = ragged_starts(n)
    of_chunk = [np.diff(np.concatenate([[0], np.cumsum(x)])[link_at]) for x in (best, count)]
    of_chunk = np.column_stack([aligner.sizes[used], *of_chunk])[place] if len(used) else np.zeros((0, 6), np.int64)
    sums = np.diff(np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(of_chunk, axis=0)])[at], axis=0)
    shown, order = aligner.shown, numbers.tolist()
    groups = [hashlib.sha256(b"".join([shown[k] for k in order[p:q]])[:-1]).hexdigest() if q > p else "" for p, q in zip(at.tolist(), at[1:].tolist())]
    return [pa.array(sums[:, k]) for k in range(6)] + [pa.array(groups, pa.string())]


def _with_broadcast(spark: SparkSession, texts: DataFrame, tokenizers, counts: DataFrame, index: DataFrame, n_pairs: int) -> DataFrame:
    """Looking up with the whole hash in each task."""
    slots = spark.sparkContext.broadcast(Slots([tuple(r) for r in index.toLocalIterator()], max(1, n_pairs // KEYS)))
    totals = {r.bucket: np.frombuffer(r.counts, np.int64) for r in counted(counts, slots).toLocalIterator()}
    count = np.concatenate([totals[b] for b in sorted(totals)] or [np.empty(0, np.int64)])  # every bucket has counts, as every pair is some text's
    first = slots.value.keys >> 32
    highest = np.zeros(int(first.max(initial=0)) + 1, np.int64)
    np.maximum.at(highest, first, count)
    sent = spark.sparkContext.broadcast((count, count == highest[first]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, hash_ = _aligner(tokenizers, show=True), slots.value
        count, best = sent.value

        def look_up(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            slot = hash_.of(pair)
            return count[slot], best[slot]

        for part, body in _texts(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), *_results(aligner, body, look_up)], ["doc_id", *RESULT.names])

    return texts.mapInArrow(run, StructType([texts.schema["doc_id"], *RESULT]))


def _with_joins(texts: DataFrame, tokenizers, counts: DataFrame) -> DataFrame:
    """Looking up without the hash in any task: blocks of texts ask for their pairs' counts."""
    totals = stored(counts.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("first", F.shiftright("pair", 32)), "totals")
    highest = totals.groupBy("first").agg(F.max("count").alias("highest"))  # one row for each id of a vocabulary
    known = totals.join(highest, "first").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for k, (part, _) in enumerate(_texts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k] * part.num_rows, pa.int64()), part.column(0), part.column(1)], ["block", "doc_id", "text"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(tokenizers)
        for part, body in _texts(batches, 2):
            (numbers, at), block = aligner.read(body), np.asarray(part.column(0))
            edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for start, end in zip(edges, edges[1:]):  # a batch may end within a block, so pairs may be asked for twice
                chunk = np.unique(numbers[at[start]:at[end]])
                pair = aligner.pairs[np.unique(aligner.links[ragged_ranges(aligner.link_at[chunk], aligner.sizes[chunk, 3])])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), block[start])), pa.array(pair)], ["block", "pair"])

    blocks = stored(texts.mapInArrow(cut, StructType([StructField("block", LongType()), *texts.schema])), "blocks")
    answers = blocks.mapInArrow(ask, "block long, pair long").distinct().join(known, "pair").select("block", "pair", "count", "best")

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        order = np.argsort(pair := np.asarray(told.column("pair")))
        pair, count, best = pair[order], np.asarray(told.column("count"))[order], np.asarray(told.column("best"))[order]

        def look_up(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(pair, wanted)
            return count[at], best[at]

        found = _results(_aligner(tokenizers, show=True), own.column("text").cast(pa.string()).to_pylist(), look_up)
        return pa.table([own.column("doc_id"), *found], ["doc_id", *RESULT.names])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, StructType([texts.schema["doc_id"], *RESULT]))


def align(docs: DataFrame, a: str, b: str, doc_id: str = "doc_id", text: str = "text", limit: int = 64 << 20) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a``: a byte-level BPE (JSON) for blank + text; ``b``: a piece model that adds the blank
    itself. ``limit``: bytes of the hash and its counts up to which tasks get them whole.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    tokenizers = spark.sparkContext.broadcast((_read(a), _read(b)))
    counts = stored(pair_counts(texts, tokenizers), "pair-counts")
    found = stored(counts.select("pair").distinct(), "pairs")
    n_pairs = found.count()
    if n_pairs * (8 + 8 + 1 + 4 // FEW) > limit:
        return _with_joins(texts, tokenizers, counts)
    return _with_broadcast(spark, texts, tokenizers, counts, build(found, n_pairs), n_pairs)
