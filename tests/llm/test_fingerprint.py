import hashlib
import re

import pytest
from pyspark.sql import functions as F

from fareloom.llm import fingerprint, queries
from tables import rows_of, stored  # noqa: I001

DOCS = "doc_id long, text string, row_key string, own string"
LONG = " ".join(f"word{i % 997}{'.' if i % 11 == 0 else ''}" for i in range(40_000))


ODD = [(1, "one two three four five six seven eight nine ten"), (2, None), (3, ""), (4, "  \n\n "), (5, "x" * 3000), (7, LONG),
       (8, "a b\nc d\n\ne f g h\n" * 30), (9, "日本語 テスト 🙂 é ü\nß " * 20), (None, "no id here at all"), (None, None), (11, "same text"), (11, "same text"),
       (11, "same text"), (11, "other text under the same id"), (12, "a b\nc d\n\ne f g h\n" * 30)]


@pytest.mark.parametrize("rows", [ODD, [], [(1, "the only one, followed by itself")], [(5, "copy of it")] * 9])
def test_the_query_equals_its_sql(spark, duck, tmp_path, rows):
    _, got, want = rows_of(spark, duck, "op11_fingerprints", stored(spark, tmp_path, [(*r, "k", "o") for r in rows], DOCS))
    assert got == want and len(got) == len(rows)


def test_the_query_equals_its_sql_on_the_sample(spark, duck, sample):
    names = sorted(queries.QUERIES["op11_fingerprints"](spark, sample).columns)
    want = sorted(duck.execute(f"select {', '.join(names)} from ({queries.ORACLES['op11_fingerprints']})").fetchall())
    got = sorted(tuple(r) for r in queries.QUERIES["op11_fingerprints"](spark, sample).select(*names).collect())
    assert got == want and got


def one(spark, a, b):
    t = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprint.tree(F.col("a")).alias("a"), fingerprint.tree(F.col("b")).alias("b"))
    a, b = F.col("a"), F.col("b")
    return t.select("a", "b", fingerprint.likeness(a, b).alias("like"), fingerprint.edit_start(a, b).alias("at"), fingerprint.fingerprint(a).alias("fa"),
                    fingerprint.fingerprint(b).alias("fb")).first()


def test_an_edit_is_found_by_its_branch(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(40)) for i in range(50))
    for i, j in ((0, 0), (17, 20), (49, 39)):
        word = f"w{i}x{j}"
        place = re.search(rf"\b{word}\b", text).start()
        row = one(spark, text, re.sub(rf"\b{word}\b", "CHANGED", text))
        assert row.at <= place and len(text[row.at:place].split()) < 40 and 0.95 < row.like < 1
        same = [x == y for x, y in zip(row.a.sections, row.b.sections)]
        assert sum(not s for s in same) <= 2 or len(row.a.sections) != len(row.b.sections)
    row = one(spark, text, text)
    assert row.at is None and row.like == 1 and row.fa == row.fb


def test_any_change_of_bytes_changes_the_root(spark):
    texts = ["", " ", "a", "a ", "a\n", "a\n\n", "a b", "a  b", "ab", "a\tb", "A b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(fingerprint.tree(F.col("t")).alias("x")).select("x.root").collect()
    assert len({r.root for r in rows}) == len(texts)
    assert rows[0].root == hashlib.sha256(b"").hexdigest()


def test_next_documents_cross_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
        rows = {r.doc_id: r.next_text for r in fingerprint.followed(docs.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows == {i: f"t{(i - 1) % 2000}" for i in range(2000)}
