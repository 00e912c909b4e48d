"""Fill-in-the-middle texts, assembled by a secondary sort.

A text is cut at two units into prefix, middle and suffix. Each part leaves as pieces of a
bounded number of units, keyed by document and place in the output; a marker goes with the
first piece of its part. ``repartitionAndSortWithinPartitions`` brings a document's pieces
to one task in output order, where they stream through an incremental digest. What streams
by is parsed again at its markers into pieces keyed by their place in the text: sorted anew,
without another shuffle as the partitioning stays, they restore it.

A text is held whole by the task that reads it, and by none after that. Sorting spills.

Defined cases: a null text is empty; the empty text, and one that holds a marker, stays
plain; a null id is hashed as an empty one; rows equal in id and text get equal results and
go to different tasks; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fareloom.llm.common import row_key

#: Markers of prefix, suffix and middle (fixed values).
MARKERS = {b"<P>": 0, b"<S>": 2, b"<M>": 1}
#: The order of prefix (0), middle (1) and suffix (2) in the output (fixed values).
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
PARTITION = 32 << 20  # bytes of text that one task sorts, on average
HEAD = -1  # the place of a document's first record, which holds what is known of it


@dataclass(frozen=True)
class Shares:
    """Percentages of texts that are transformed, and of those that start with the suffix."""

    transformed: int = 90
    spm: int = 20


class Units:
    """The units ``[A-Za-z]+|[^A-Za-z]`` of a text, block by block, so that arrays stay small."""

    block = 1 << 20

    def __init__(self, text: str):
        self.text = text
        self.before = [0]
        for start in range(0, len(text), self.block):
            self.before.append(self.before[-1] + int(np.count_nonzero(self._starts(start))))
        self.last = (-1, np.empty(0, np.int64))

    def __len__(self) -> int:
        return self.before[-1]

    def _starts(self, start: int) -> np.ndarray:
        """Whether a unit starts, for each character of the block."""
        ahead = 1 if start else 0
        codes = np.frombuffer(self.text[start - ahead:start + self.block].encode("utf-32-le"), "<u4")
        letter = ((codes | 32) - np.uint32(97)) < 26
        starts = ~letter
        starts[1:] |= ~letter[:-1]
        if not ahead:
            starts[:1] = True
        return starts[ahead:]

    def offset(self, unit: int) -> int:
        """The character at which a unit starts; of the one after the last, the text's end."""
        if unit >= len(self):
            return len(self.text)
        which = int(np.searchsorted(self.before, unit, side="right")) - 1
        if self.last[0] != which:
            self.last = (which, np.flatnonzero(self._starts(which * self.block)) + which * self.block)
        return int(self.last[1][unit - self.before[which]])


def draws(doc_id) -> list[int]:
    """Four numbers that depend on the id alone."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]


def plan(doc_id, text: str, units: Units, shares: Shares) -> tuple[str, int, int]:
    """The form, and the units after which prefix and middle end."""
    h1, h2, h3, h4 = draws(doc_id)
    n = len(units)
    if not n or h3 % 100 >= shares.transformed or any(m.decode() in text for m in MARKERS):
        return "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return "spm" if h4 % 100 < shares.spm else "psm", a, b


def cut(doc_id, text: str, shares: Shares, size: int) -> Iterator[tuple]:
    """What is known of the output (doc_id, n, form, prefix_chars, middle_chars), then its pieces."""
    units = Units(text)
    form, a, b = plan(doc_id, text, units, shares)
    if form == "plain":
        parts, names = [(0, len(units))], {}
        yield doc_id, len(units), form, None, None
    else:
        spans = [(0, a), (a, b), (b, len(units))]
        parts, names = [spans[p] for p in FORMS[form]], {i: m for i, p in enumerate(FORMS[form]) for m, of in MARKERS.items() if of == p}
        yield doc_id, len(units), form, units.offset(a), units.offset(b) - units.offset(a)
    for i, (start, end) in enumerate(parts):
        marker = names.get(i, b"")
        for k in range(start, max(end, start + 1), size):
            yield marker + text[units.offset(k):units.offset(min(end, k + size))].encode()
            marker = b""


def _by_document(key: tuple[bytes, int]) -> int:
    return zlib.crc32(key[0])


def pieces(docs: DataFrame, shares: Shares = Shares(), size: int = 8192, doc_id: str = "doc_id", text: str = "text") -> RDD:
    """((document, place in the output), piece), sorted within partitions by document and place.

    A document's key tells equal rows apart by the task that read them and their number
    among that task's equal rows, so that copies spread, whatever order a task reads them in.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    partitions = max(n_bytes // PARTITION + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def emit(read: Iterator) -> Iterator[tuple]:
        task, seen = TaskContext.get().partitionId(), {}
        for i, key, body in read:
            seen[key] = again = seen.get(key, -1) + 1
            document = bytes(key) + struct.pack(">IQ", task, again)
            for place, piece in enumerate(cut(i, body, shares, size), HEAD):
                yield (document, place), piece

    return rows.rdd.mapPartitions(emit).repartitionAndSortWithinPartitions(partitions, _by_document)


def outputs(docs: DataFrame, shares: Shares = Shares(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: the transformed texts."""
    def join(stream: Iterator) -> Iterator[tuple]:
        head, parts = None, []
        for (_, place), piece in stream:
            if place == HEAD:
                if head:
                    yield *head, b"".join(parts).decode()
                head, parts = piece, []
            else:
                parts.append(piece)
        if head:
            yield *head, b"".join(parts).decode()

    return docs.sparkSession.createDataFrame(pieces(docs, shares, doc_id=doc_id, text=text).mapPartitions(join), _schema(docs, doc_id, "output"), verifySchema=False)


def _schema(docs: DataFrame, doc_id: str, *strings: str) -> StructType:
    return StructType([StructField("doc_id", docs.schema[doc_id].dataType), StructField("n", LongType()), StructField("form", StringType()),
                       StructField("prefix_chars", LongType()), StructField("middle_chars", LongType()), *[StructField(s, StringType()) for s in strings]])


def _assembled(stream: Iterator) -> Iterator[tuple]:
    """Digests the output as it streams by, and parses it into pieces at their place in the text."""
    document, known, digest, part, n = None, None, None, 0, 0
    for (key, place), piece in stream:
        if place == HEAD:
            if known:
                yield (document, HEAD), (*known, digest.hexdigest())
            document, known, digest, part, n = key, piece, hashlib.sha256(), 0, 0
            continue
        digest.update(piece)
        if known[2] != "plain" and (found := MARKERS.get(piece[:3])) is not None:
            part, piece = found, piece[3:]  # no text of this form holds a marker
        yield (document, part << 48 | n), piece
        n += 1
    if known:
        yield (document, HEAD), (*known, digest.hexdigest())


def _restored(stream: Iterator) -> Iterator[tuple]:
    known, digest = None, None
    for (_, place), piece in stream:
        if place == HEAD:
            if known:
                yield *known, digest.hexdigest()
            known, digest = piece, hashlib.sha256()
        else:
            digest.update(piece)
    if known:
        yield *known, digest.hexdigest()


def digests(docs: DataFrame, shares: Shares = Shares(), size: int = 8192, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``.

    No task holds a text: output and restored text stream through digests piece by piece.
    """
    sent = pieces(docs, shares, size, doc_id, text)
    parsed = sent.mapPartitions(_assembled, preservesPartitioning=True)
    back = parsed.repartitionAndSortWithinPartitions(sent.getNumPartitions(), _by_document)  # same partitioning: sorts only
    return docs.sparkSession.createDataFrame(back.mapPartitions(_restored), _schema(docs, doc_id, "output_sha256", "restored_sha256"), verifySchema=False)
