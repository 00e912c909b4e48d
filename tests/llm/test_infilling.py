import hashlib
import re

import pytest

from fareloom.llm import infilling, queries
from tables import rows_of, stored  # noqa: I001


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


TEXTS = ["", None, "a", "<", "<P", "P><S", "a<P>b", "<M>", "<<<S", "word " * 50, "x" * 70_000, "1,2;3 " * 9000, "日本語 é🙂 test\n\r\n end", "a\x00b \x1c c", "@[`{AZaz"]
ROWS = [(i * 37 + k, t) for i, t in enumerate(TEXTS) for k in range(9)] + [(None, "an id that is null"), (None, None)] + [(5, "copies of one row")] * 40


@pytest.mark.parametrize("size", [8192, 3])
def test_outputs_and_digests_equal_brute_force(spark, size, monkeypatch):
    monkeypatch.setattr(infilling.Units, "block", 1000)
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, key string, n int").repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [brute(*r) for r in ROWS]
    assert sorted(map(tuple, infilling.outputs(docs).collect()), key=repr) == sorted(want, key=repr)
    got = infilling.digests(docs, size=size).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(*w[:5], sha(w[5]), sha(t or "")) for w, (_, t) in zip(want, ROWS)], key=repr)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_units_in_small_blocks(monkeypatch):
    text = "ab1cd  EF_g" * 50
    units = [m.start() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
    for block in (1, 2, 7, 1 << 20):
        monkeypatch.setattr(infilling.Units, "block", block)
        found = infilling.Units(text)
        assert len(found) == len(units) and [found.offset(k) for k in range(len(units) + 1)] == [*units, len(text)]


def test_copies_go_to_many_tasks(spark):
    docs = spark.createDataFrame([(1, "the same row")] * 400, "doc_id long, text string").repartition(4)
    sizes = infilling.pieces(docs).mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 400 * 4 or sum(sizes) == 400 * 2
    assert max(sizes) < sum(sizes) / 2


def test_a_document_is_not_shuffled_twice(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    sent = infilling.pieces(docs)
    again = sent.mapPartitions(infilling._assembled, preservesPartitioning=True)
    assert again.partitionBy(sent.getNumPartitions(), infilling._by_document) is again


@pytest.mark.parametrize("rows", [[], ROWS])
def test_the_query_equals_its_sql(spark, duck, tmp_path, rows):
    table = stored(spark, tmp_path, [r for r in rows if not r[1] or "\x00" not in r[1]], "doc_id long, text string")
    _, got, want = rows_of(spark, duck, "op13_infilling", table)
    assert got == want


def test_the_query_equals_its_sql_on_the_sample(spark, duck, sample):
    names = sorted(queries.QUERIES["op13_infilling"](spark, sample).columns)
    want = sorted(duck.execute(f"select {', '.join(names)} from ({queries.ORACLES['op13_infilling']})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in queries.QUERIES["op13_infilling"](spark, sample).select(*names).collect()), key=repr) == want
