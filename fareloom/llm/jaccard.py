"""Exact n-gram Jaccard join: which texts share enough of their word shingles.

1. *Candidates.* A text can only have a partner if ``threshold`` of its shingles occur in
   another text. Shingles are counted by shards of their hash; a shard is told about a
   shingle once per batch of texts, and shingles that a batch has seen twice need no answer,
   so a passage held by a third of all texts is no large group. Copies count as one text.
2. *Tiles.* Partners share one of the first ``n - ceil(threshold * n) + 1`` shingles in order
   of hash, and their sizes lie in the same band or in neighbouring ones. Texts meet in
   tiles by (shard of these shingles, size band); shards grow in number with the shingles, so
   a tile is cut into few parts. A shingle held by more candidates than a tile takes has
   tiles of its own: its parts first meet the first part only, and only if that does not
   join them all each other. In a tile, bitmap signatures of parities bound the overlap from
   above: each bit that differs is one shingle or more in one set only. Pairs within the
   bound give the edges of a spanning forest, never all pairs.
3. *Verification.* The groups so joined (supersets of the components) are cut into bounded
   parts, and sorted-array intersections decide. Texts already linked are not compared again;
   large groups that the first round does not join entirely are compared part by part.

Defined cases: null texts and texts without words have no shingles and link with nothing,
not with each other; texts equal byte for byte are linked; the component is the smallest
non-null id reachable; equal rows get equal results; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fareloom.llm.common import NOT_SPACE, WordHashes, mixed, ragged_ranges, ragged_starts, release, slices, stored, text_key
from fareloom.llm.components import components


@dataclass(frozen=True)
class Join:
    """Words of a shingle, and the threshold as a fraction of whole numbers. The other numbers
    only bound memory: texts of a tile and of a part to verify, and text bytes (or shingles)
    behind a shard."""

    words: int = 5
    over: int = 3
    under: int = 4
    tile: int = 16384
    part: int = 1024
    shard_bytes: int = 32 << 20
    shard_rows: int = 1 << 21


class Shingler:
    """Sorted distinct shingle hashes of a text."""

    def __init__(self, words: int):
        self.words, self.known = words, WordHashes()

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        hashes, k = self.known.of(words), min(self.words, len(words))
        value = np.full(len(hashes) - k + 1, k, np.uint64)
        for i in range(k):
            value = (value * np.uint64(0x9E3779B97F4A7C15)) ^ mixed(hashes[i:len(hashes) - k + 1 + i] + np.uint64(i))
        return np.unique(mixed(value))


def required(size: np.ndarray, join: Join) -> np.ndarray:
    """The least overlap of two sets whose sizes add up to ``size``."""
    return -(-join.over * size // (join.over + join.under))


# ---- candidates -------------------------------------------------------------------------


def _repeated_shingles(texts: DataFrame, join: Join) -> DataFrame:
    """``tid, n, repeated``: shingles of each distinct text, and how many occur in another text."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(32, max(3, int(np.ceil(np.log2(max(1, total / join.shard_bytes))))))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, task, number = Shingler(join.words), TaskContext.get().partitionId(), 0
        for part in slices(batches, 1, 6 << 20):
            slice_id, number = task << 32 | number, number + 1
            sets, tids = [], []
            for tid, text in dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist())).items():
                tids.append(tid)
                sets.append(shingler.of(text))
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(every, kind="stable")
            sorted_ = every[order]
            first = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])) if len(every) else np.zeros(0, np.int64)
            count = np.diff(np.append(first, len(every)))
            again = np.zeros(len(every), bool)
            again[order] = np.repeat(count > 1, count)
            keys = np.frombuffer(b"".join(tids), "V16")
            rows = [(number % (1 << bits), slice_id, True, keys.tobytes(), sizes.astype("<i4").tobytes(),
                     np.bincount(owner[again], minlength=len(sets)).astype("<i4").tobytes())]
            # shingles of one text here, by shard and text; those of several once, without a text
            shard = (every >> np.uint64(64 - bits)).astype(np.int64)
            alone = np.flatnonzero(~again)
            alone = alone[np.argsort(shard[alone], kind="stable")]
            many = sorted_[first[count > 1]]
            where, many_where = shard[alone], (many >> np.uint64(64 - bits)).astype(np.int64)
            present = np.union1d(where, many_where)  # shards without a shingle here cost nothing
            ends = lambda at: zip(np.searchsorted(at, present).tolist(), np.searchsorted(at, present, "right").tolist())
            low = lambda x: (x >> np.uint64(32 - bits)).astype("<u4")
            for p, (a, b), (c, d) in zip(present.tolist(), ends(where), ends(many_where)):
                own, shared = alone[a:b], many[c:d]
                who, each = np.unique(owner[own], return_counts=True)
                rows.append((p, slice_id, False, keys[who].tobytes(), each.astype("<i4").tobytes(), low(np.concatenate([every[own], shared])).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()))], ["shard", "slice", "sizes", "tids", "counts", "data"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each row of a shard, the texts that have repeated shingles there and how many."""
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["slice", "tids", "n", "repeated"])

        def solved(group: list[dict]) -> pa.RecordBatch:
            tids = [np.frombuffer(r["tids"], "V16") for r in group]
            counts = np.concatenate([np.frombuffer(r["counts"], "<i4") for r in group]).astype(np.int64)
            of_text, shared = [], []
            for r in group:
                data, m = np.frombuffer(r["data"], "<u4"), int(np.frombuffer(r["counts"], "<i4").sum())
                of_text.append(data[:m])
                shared.append(data[m:])
            values, shared = np.concatenate(of_text), np.unique(np.concatenate(shared))
            same = np.unique(np.concatenate(tids), return_inverse=True)[1]  # copies in several batches are one text
            pairs = np.unique(values.astype(np.uint64) << np.uint64(32) | np.repeat(same, counts).astype(np.uint64)) >> np.uint64(32)
            twice = np.unique(pairs[1:][pairs[1:] == pairs[:-1]]).astype(np.uint32)
            known = np.union1d(twice, shared)
            place = np.minimum(np.searchsorted(known, values), max(0, len(known) - 1))
            hit = known[place] == values if len(known) else np.zeros(len(values), bool)
            hits = np.bincount(np.repeat(np.arange(len(counts)), counts), hit, len(counts)).astype("<i4")
            rows = []
            for r, own, found in zip(group, tids, np.split(hits, np.cumsum([len(t) for t in tids])[:-1])):
                some = np.flatnonzero(found)
                rows.append((r["slice"], own[some].tobytes(), np.zeros(len(some), "<i4").tobytes(), found[some].tobytes()))
            return packed(rows)

        group: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if row["sizes"]:
                    yield packed([(row["slice"], row["tids"], row["counts"], row["data"])])
                    continue
                if group and group[0]["shard"] != row["shard"]:
                    yield solved(group)
                    group = []
                group.append(row)
        if group:
            yield solved(group)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums over all shards, a row for each text of a batch."""
        def summed(group: list[tuple]) -> pa.RecordBatch:
            tids = np.concatenate([np.frombuffer(r[1], "V16") for r in group])
            n, repeated = (np.concatenate([np.frombuffer(r[k], "<i4") for r in group]) for k in (2, 3))
            tids, which = np.unique(tids, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in tids], pa.binary())] + [
                pa.array(np.bincount(which, x, len(tids)).astype(np.int64)) for x in (n, repeated)], ["tid", "n", "repeated"])

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    yield summed(group)
                    group = []
                group.append(row)
        if group:
            yield summed(group)

    chunks = texts.mapInArrow(told, "shard long, slice long, sizes boolean, tids binary, counts binary, data binary")
    answers = chunks.repartition("shard").sortWithinPartitions("shard").mapInArrow(asked, "slice long, tids binary, n binary, repeated binary")
    sums = answers.repartition("slice").sortWithinPartitions("slice").mapInArrow(answered, "tid binary, n long, repeated long")
    # each batch gets the whole answer about its texts, so copies in several batches agree
    return sums.groupBy("tid").agg(F.max("n").alias("n"), F.max("repeated").alias("repeated"))


def _signature(own: np.ndarray) -> bytes:
    """Parities of a set's hashes by bit, two to four bits for each member."""
    width = 1 << int(np.clip(np.ceil(np.log2(max(1, len(own)))) + 1, 6, 13))
    odd = np.bincount((own & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _sets(texts: DataFrame, join: Join) -> DataFrame:
    """``tid, n, members, bitmap, prefix``: the set, its signature and its first shingles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(join.words)
        for part in slices(batches, 1, 4 << 20):
            sets = [shingler.of(t) for t in part.column(1).to_pylist()]
            first = [s[:len(s) - int(-(-join.over * len(s) // join.under)) + 1].view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary()),
                 pa.array([_signature(s) for s in sets], pa.binary()), pa.array(first, pa.list_(pa.int64()))],
                ["tid", "n", "members", "bitmap", "prefix"])

    return texts.mapInArrow(run, "tid binary, n int, members binary, bitmap binary, prefix array<long>")


# ---- tiles ------------------------------------------------------------------------------


class Forest:
    """Union-find over row numbers; remembers the unions it made."""

    def __init__(self, n: int, labels: list | None = None):
        self.root, self.made = np.arange(n), []
        if labels is not None:
            self.root = np.unique(np.array([hash(x) for x in labels]), return_index=True, return_inverse=True)
            self.root = self.root[1][self.root[2]]

    def join(self, a: int, others: np.ndarray) -> None:
        """Unites the trees of ``others`` with that of ``a``."""
        roots, first = np.unique(self.root[others], return_index=True)
        self.made += [(a, int(others[k])) for k in first.tolist()]
        self.root[np.isin(self.root, roots)] = self.root[a]


def folded(bitmaps: list[bytes]) -> np.ndarray:
    """Signatures as rows of 64-bit words, all folded to the smallest width among them.

    The bit of a hash is its remainder, so halves of a power of two fold by exclusive or.
    """
    width = min(map(len, bitmaps))
    out = np.zeros((len(bitmaps), width), np.uint8)
    for i, b in enumerate(bitmaps):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), axis=0)
    return out.view(np.uint64)


def possible(x: int, rest: np.ndarray, n: np.ndarray, bits: np.ndarray, join: Join) -> np.ndarray:
    """Which rows may reach the threshold with row ``x``, by size and by bits that differ."""
    total = n[x] + n[rest]
    need = required(total, join)
    rest = rest[need <= np.minimum(n[x], n[rest])]
    if not len(rest):
        return rest
    apart = np.bitwise_count(bits[rest] ^ bits[x]).sum(axis=1, dtype=np.int64)
    total = n[x] + n[rest]
    return rest[(total - apart) // 2 >= required(total, join)]


def _tile_edges(rows: DataFrame, join: Join) -> DataFrame:
    """``a, b``: a spanning forest of the pairs that may link, tile by tile
    (``tile, tid, n, bitmap, tokens, label``); rows of one label are joined already."""
    def solved(tile: list[tuple]) -> pa.RecordBatch:
        n, bits = np.array([r[2] for r in tile], np.int64), folded([r[3] for r in tile])
        lengths = np.array([len(r[4]) for r in tile])
        token, row = np.concatenate([np.asarray(r[4], np.int64) for r in tile]), np.repeat(np.arange(len(tile)), lengths)
        order = np.lexsort((row, token))
        token, row = token[order], row[order]
        forest = Forest(len(tile), [r[5] for r in tile])
        for own in np.split(row, np.flatnonzero(token[1:] != token[:-1]) + 1):
            while len(own) > 1:
                x, own = own[0], own[1:]
                rest = own[forest.root[own] != forest.root[x]]
                if not len(rest):
                    break  # all that follow are joined already
                rest = possible(x, rest, n, bits, join)
                if len(rest):
                    forest.join(x, rest)
        return pa.RecordBatch.from_arrays([pa.array([tile[a][1] for a, _ in forest.made], pa.binary()),
                                           pa.array([tile[b][1] for _, b in forest.made], pa.binary())], ["a", "b"])

    return _by_group(rows.select("tile", "tid", "n", "bitmap", "tokens", "label"), "tile", solved, "a binary, b binary")


def _by_group(rows: DataFrame, key: str, solved, schema: str) -> DataFrame:
    """``solved(list of rows)`` for each value of ``key``, many groups to a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    if len(group) > 1:
                        yield solved(group)
                    group = []
                group.append(row)
        if len(group) > 1:
            yield solved(group)

    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, schema)


def _part_of(tid: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(tid), parts).cast("int")


def _pairs_of_parts(part: Column, parts: Column) -> Column:
    """The pairs (low, high) of parts that a row of one part takes part in, as low * parts + high."""
    return F.transform(F.sequence(F.lit(0), parts - 1),
                       lambda other: F.least(part, other).cast("long") * parts + F.greatest(part, other))


def _with_first(part: Column, parts: Column) -> Column:
    """The tiles of a part when each part meets the first only; tile p holds the parts 0 and p."""
    return F.transform(F.when(part == 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(part)), lambda p: p.cast("long"))


def _candidate_edges(sets: DataFrame, join: Join, paths: list[str]) -> DataFrame:
    light = sets.select("tid", "n", F.explode("prefix").alias("token"))
    # neighbouring bands hold all sizes that can reach the threshold
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(join.under / join.over)) + F.lit(1e-9)).cast("int")
    light = light.select("tid", "token", F.explode(F.array(band, band + 1)).alias("band"))
    counts = light.groupBy("token", "band").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    total = counts.agg(F.sum("held")).first()[0] or 0
    shards = max(4, int(total // join.shard_rows))
    met = light.join(counts, ["token", "band"])
    # all of a text's shingles in a shard travel as one row; a shingle that fills tiles has a shard of its own
    own = F.col("held") > join.tile
    shard = F.when(own, F.xxhash64("token")).otherwise(F.pmod(F.xxhash64("token"), F.lit(shards)))
    placed = stored(met.groupBy(shard.alias("shard"), own.alias("own"), "band", "tid").agg(F.collect_list("token").alias("tokens")), "placed", paths)
    group = ["shard", "own", "band"]
    parts = F.ceil(F.count(F.lit(1)) / join.tile).cast("int")
    sized = placed.join(placed.groupBy(*group).agg(parts.alias("parts")), group).withColumn("part", _part_of(F.col("tid"), F.col("parts")))
    light_sets = sets.select("tid", "n", "bitmap")

    def tiled(rows: DataFrame, places: Column, round_: int) -> DataFrame:
        tiles = F.transform(places, lambda p: F.xxhash64(*group, p, F.lit(round_)))
        return _tile_edges(rows.withColumn("tile", F.explode(tiles)).join(light_sets, "tid"), join)

    every = _pairs_of_parts(F.col("part"), F.col("parts"))
    # first round: shards of many shingles whole; a shard of one shingle only each part with the first
    places = F.when(F.col("own"), _with_first(F.col("part"), F.col("parts"))).otherwise(every)
    first = stored(tiled(sized.withColumn("label", F.col("tid")), places, 0), "tiled", paths)
    wide = sized.where("own and parts > 1")
    if wide.isEmpty():
        return first
    # second round: shards of one shingle that are not joined entirely
    joined = components(first).select(F.col("node").alias("tid"), "root")
    wide = wide.join(joined, "tid", "left").withColumn("label", F.coalesce("root", "tid")).drop("root")
    open_ = wide.groupBy(*group).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select(*group)
    return first.unionByName(tiled(wide.join(open_, group, "left_semi"), every, 1))


# ---- verification -----------------------------------------------------------------------


def _verified(rows: DataFrame, join: Join) -> DataFrame:
    """``a, b``: a spanning forest of the links inside each group of rows
    (``tile, tid, n, bitmap, members, label``); rows of one label are linked already."""
    def solved(group: list[tuple]) -> pa.RecordBatch:
        group.sort(key=lambda r: r[1])
        n, bits = np.array([r[2] for r in group], np.int64), folded([r[3] for r in group])
        sets = [np.frombuffer(r[4], np.uint64) for r in group]
        forest = Forest(len(group), [r[5] for r in group])
        own = np.arange(len(group))
        while len(own) > 1:
            x, own = own[0], own[1:]
            rest = own[forest.root[own] != forest.root[x]]
            if not len(rest):
                break
            rest = possible(x, rest, n, bits, join)
            for some in np.array_split(rest, -(-len(rest) // 256)) if len(rest) else []:
                every = np.concatenate([sets[k] for k in some])
                place = np.minimum(np.searchsorted(sets[x], every), len(sets[x]) - 1)
                overlap = np.add.reduceat((sets[x][place] == every).astype(np.int64), ragged_starts(n[some])[:-1])
                linked = some[overlap >= required(n[x] + n[some], join)]
                if len(linked):
                    forest.join(x, linked)
        return pa.RecordBatch.from_arrays([pa.array([group[a][1] for a, _ in forest.made], pa.binary()),
                                           pa.array([group[b][1] for _, b in forest.made], pa.binary())], ["a", "b"])

    return _by_group(rows.select("tile", "tid", "n", "bitmap", "members", "label"), "tile", solved, "a binary, b binary")


def _links(sets: DataFrame, join: Join, paths: list[str]) -> DataFrame:
    """``node, root`` over all texts that have a partner."""
    groups = components(_candidate_edges(sets, join, paths))
    sized = groups.join(groups.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / join.part).cast("int").alias("parts")), "root")
    members = stored(sized.select(F.col("node").alias("tid"), F.col("root").alias("block"), "parts",
                                  _part_of(F.col("node"), F.col("parts")).alias("part")).join(sets, "tid").drop("prefix"), "blocks", paths)
    # first round: every part with itself and with the first part
    tiles = F.transform(_with_first(F.col("part"), F.col("parts")), lambda p: F.xxhash64("block", p, F.lit(0)))
    first = stored(_verified(members.withColumn("tile", F.explode(tiles)).withColumn("label", F.col("tid")), join), "links")
    linked = components(first)
    # second round: groups of several parts that are not joined entirely, all pairs of parts
    large = members.where("parts > 1").join(linked.select(F.col("node").alias("tid"), "root"), "tid", "left") \
        .withColumn("label", F.coalesce("root", "tid")).drop("root")
    open_ = large.groupBy("block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("block")
    pairs = F.transform(_pairs_of_parts(F.col("part"), F.col("parts")), lambda p: F.xxhash64("block", p, F.lit(1)))
    second = stored(_verified(large.join(open_, "block", "left_semi").withColumn("tile", F.explode(pairs)), join), "links")
    return linked if second.isEmpty() else components(first.unionByName(second))


def join_texts(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, tid, n_shingles, component_id, root``: one row for each row of ``docs``.

    ``tid`` tells distinct texts apart; ``root`` is the ``tid`` that stands for the component.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_key(text).alias("tid"), F.col(text).cast("string").cast("binary").alias("text"))
    texts = rows.where("text is not null").select("tid", "text")
    paths: list[str] = []
    counted = stored(_repeated_shingles(texts, join), "shingles", paths)
    distinct = stored(rows.groupBy("tid").agg(F.min("doc_id").alias("least")), "texts", paths)
    able = counted.where((F.col("n") > 0) & (join.under * F.col("repeated") >= join.over * F.col("n"))).select("tid")
    # one row stands for all copies; with the id in the key, a text of very many copies is spread
    chosen = distinct.join(able, "tid").select(F.col("tid").alias("tid_"), "least")
    texts = rows.join(chosen, (F.col("tid") == F.col("tid_")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("tid", "text")
    sets = stored(_sets(texts.dropDuplicates(["tid"]), join), "sets", paths)
    roots = _links(sets, join, paths)
    rooted = distinct.join(roots.withColumnRenamed("node", "tid"), "tid", "left").select("tid", "least", F.coalesce("root", "tid").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component")), "root").select("tid", "root", "component")
    known = stored(counted.select("tid", "n").join(named, "tid"), "named")
    release(docs.sparkSession, paths)
    size = F.coalesce("n", F.lit(0).cast("long"))
    return rows.select("doc_id", "tid").join(known, "tid", "left").select(
        "doc_id", "tid", size.alias("n_shingles"), F.when(size == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "root")


def keep_one(docs: DataFrame, join: Join = Join(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that of the smallest id.

    A null id comes last; among texts of one id, the smallest ``tid`` stays, and of equal rows
    one. Rows without words link with nothing and all stay.
    """
    linked = join_texts(docs, join, doc_id, text).where("n_shingles > 0")
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tid")).alias("first"))
    chosen = first.select(F.col("first.doc_id").alias("id_"), F.col("first.tid").alias("tid_"))
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).alias("doc_id"), text_key(text).alias("tid"))
    one = rows.join(chosen, (F.col("tid") == F.col("tid_")) & F.col("doc_id").eqNullSafe(F.col("id_"))) \
        .groupBy("tid", "doc_id").agg(F.first("row").alias("row")).select("row.*")
    wordless = docs.where(~F.regexp_like(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(NOT_SPACE)))
    return one.unionByName(wordless)
