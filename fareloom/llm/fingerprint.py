"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections of a text.

The text is cut after words. A paragraph ends with a line, a section with a blank line or at
a paragraph whose own digest says so, and long paragraphs are cut into pieces of a few words
at words that say so. As the content alone decides where to cut, an edit moves no cut
elsewhere. Every node is told by the digest of its children and the root by SHA-256: equal
texts have equal fingerprints, a differing branch leads to the place of an edit, and the
share of the text under common pieces is the likeness. DataFrame functions only.

Defined cases: a null text is empty; the empty text has no branches, and is alike (1) to the
empty text and to no other (0); a text without white space is one piece; a piece that comes
twice in a text counts once in a likeness; rows equal in id and text each have the other as
their next document; null ids come last; the only document is its own next one; an empty
table gives an empty result; further columns are not read. Nothing but the text itself
bounds the arrays of one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fareloom.llm.common import let, row_key, stored

#: A word with the white space after it; white space at the start of a text is a word too.
WORD = r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+"
PIECE = 6  # a word in so many ends a piece
SECTION = "4"  # a paragraph whose digest is below this, one in four, ends a section
NAME = 10  # hexadecimal digits of a digest in the name of a node


def _cut(items: Column, ends: Callable[[Column], Column], node: Callable[[Column], Column]) -> Column:
    """``node`` of each run of ``items``; a run ends with an item that ``ends`` or the last."""
    marks = F.transform(items, lambda x, i: F.when(ends(x) | (i + 1 == F.size(items)), i + 1))
    return let(F.filter(marks, lambda m: m.isNotNull()), lambda m: F.transform(
        m, lambda end, j: let(F.coalesce(F.get(m, j - 1), F.lit(0)), lambda start: node(F.slice(items, start + 1, end - start)))))


def _digests(children: Column) -> Column:
    return F.array_join(F.transform(children, lambda c: c["digest"]), "")


def _newlines(word: Column) -> Column:
    return F.length(word) - F.length(F.translate(word, "\n", ""))


def _piece(words: Column) -> Column:
    return let(F.array_join(words, ""), lambda body: F.struct(
        F.md5(body.cast("binary")).alias("digest"), F.length(body).alias("size"), _newlines(F.element_at(words, -1)).alias("ends")))


def _paragraph(pieces: Column) -> Column:
    return let(F.md5(_digests(pieces).cast("binary")), lambda d: F.struct(
        d.alias("digest"), F.size(pieces).alias("size"), ((F.element_at(pieces, -1)["ends"] > 1) | (d < SECTION)).alias("ends")))


def _section(paragraphs: Column) -> Column:
    return F.struct(F.md5(_digests(paragraphs).cast("binary")).alias("digest"), F.size(paragraphs).alias("size"))


def _names(nodes: Column) -> Column:
    """A node's name: the start of its digest, and the number of its children (of a piece: characters)."""
    return F.transform(nodes, lambda n: F.concat(F.substring(n["digest"], 1, NAME), F.lit("."), n["size"].cast("string")))


def tree(text: Column) -> Column:
    """Struct of ``root`` and the names of all ``sections``, ``paragraphs`` and ``pieces`` in order."""
    words = F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD), F.lit(0))
    ends_piece = lambda w: (F.pmod(F.ascii(w) + 3 * F.length(w), F.lit(PIECE)) == 0) | F.contains(w, F.lit("\n"))
    pieces = let(words, lambda w: _cut(w, ends_piece, _piece))
    above = lambda p: let(_cut(p, lambda x: x["ends"] > 0, _paragraph), lambda q: let(
        _cut(q, lambda x: x["ends"], _section), lambda s: F.struct(
            F.sha2(_digests(s).cast("binary"), 256).alias("root"), _names(s).alias("sections"), _names(q).alias("paragraphs"), _names(p).alias("pieces"))))
    return let(pieces, above)


def fingerprint(t: Column) -> Column:
    """The tree as one string: root, sections, paragraphs, pieces."""
    return F.concat_ws(";", t["root"], *[F.array_join(t[level], ",") for level in ("sections", "paragraphs", "pieces")])


def _sizes(names: Column) -> Column:
    """The sum of the names' sizes."""
    return F.aggregate(names, F.lit(0).cast("long"), lambda total, n: total + F.substring(n, NAME + 2, 12).cast("long"))


def likeness(a: Column, b: Column) -> Column:
    """The share of the larger text that lies under pieces of both trees, from 0 to 1."""
    def share(p: Column, q: Column) -> Column:
        larger = F.greatest(_sizes(F.array_distinct(p)), _sizes(F.array_distinct(q)))
        return F.when(larger > 0, _sizes(F.array_intersect(p, q)) / larger).otherwise(F.lit(1.0))
    return let(a["pieces"], lambda p: let(b["pieces"], lambda q: share(p, q)))


def edit_start(a: Column, b: Column) -> Column:
    """The character of ``a`` at which the first branch that differs from ``b`` begins; null if none does.

    From the root down: equal sections are passed over, then equal paragraphs of the first
    section that differs, then equal pieces of its first paragraph that differs.
    """
    def same(level: str, skip: Column) -> Column:  # nodes that are equal from the start, the first ``skip`` known to be
        p = F.slice(a[level], skip + 1, F.size(a[level]))
        q = F.slice(b[level], skip + 1, F.size(b[level]))
        return let(q, lambda other: skip + F.coalesce(
            F.nullif(F.array_position(F.transform(p, lambda x, i: x.eqNullSafe(F.get(other, i))), False).cast("int"), F.lit(0)) - 1, F.size(p)))

    def below(level: str, n: Column) -> Column:  # how many children the first n nodes have
        return _sizes(F.slice(a[level], F.lit(1), n)).cast("int")

    pieces = let(same("sections", F.lit(0)), lambda s: let(same("paragraphs", below("sections", s)), lambda p: same("pieces", below("paragraphs", p))))
    return F.when(a["root"] != b["root"], _sizes(F.slice(a["pieces"], F.lit(1), pieces)))


def followed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text, next_text, times``: texts (null: empty) with that of the next document, ids descending.

    The last document is followed by the first. Rows equal in id and text are one entry;
    they follow one another, so an entry of n rows stands for n - 1 that are followed by
    themselves (a row of ``times`` n - 1) and one that is not. Only ids are ordered, in
    ranges; a range's last row takes the next range's first, of which there is one a range.
    Texts are then met by key.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), row_key(doc_id, text).alias("row_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.col("row_key")]
    ids = rows.groupBy("doc_id", "row_key").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(*order)
    ids = stored(ids.withColumn("part", F.spark_partition_id()), "followed")
    inside = Window.partitionBy("part").orderBy(*order)
    heads = ids.withColumn("place", F.row_number().over(inside)).where("place = 1")
    every = Window.orderBy("part")  # over one row for each range
    heads = heads.select("part", F.coalesce(F.lead("row_key").over(every), F.first("row_key").over(every)).alias("head"))
    links = ids.withColumn("own", F.lead("row_key").over(inside)).join(heads, "part").select(
        "doc_id", "n", F.col("row_key").alias("key"), F.coalesce("own", "head").alias("next_key"))
    texts = rows.select("row_key", "text").dropDuplicates(["row_key"])
    sent = texts.join(links.select("key", "next_key"), F.col("row_key") == F.col("next_key")).select(F.col("key").alias("to"), F.col("text").alias("next_text"))
    met = texts.join(links, F.col("row_key") == F.col("key")).join(sent, F.col("row_key") == F.col("to"))
    one = F.struct(F.lit(1).cast("long").alias("times"), F.col("next_text"))
    again = F.struct((F.col("n") - 1).alias("times"), F.col("text").alias("next_text"))
    return met.select("doc_id", "text", F.explode(F.when(F.col("n") > 1, F.array(one, again)).otherwise(F.array(one))).alias("next")).select(
        "doc_id", "text", "next.next_text", "next.times")


def compare_edited(docs: DataFrame, share: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's tree beside those of an edited form and of the next document.

    The edit replaces the last ``n_chars // share`` characters by the next document's first
    as many. Columns: doc_id, n_chars, edited (text), own, edit, next (trees).
    """
    rows = followed(docs, doc_id, text)
    n = F.length("text")
    cut = F.floor(n / share).cast("int")
    edited = F.concat(F.substring("text", 1, n - cut), F.substring("next_text", 1, cut))
    trees = rows.select("doc_id", "times", n.cast("long").alias("n_chars"), edited.alias("edited"), tree(F.col("text")).alias("own"),
                        tree(F.col("next_text")).alias("next")).withColumn("edit", tree(F.col("edited")))
    return trees.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("copy", "times")
