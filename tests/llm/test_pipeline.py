"""The pipeline and the quality rules against plain versions."""

import numpy as np
from test_jaccard import plain_components
from test_lines_and_packing import plain_blocks
from test_substrings import plain_marks

import corpus_pipeline
from fareloom.llm import packing, quality, queries
from fareloom.llm.common import read_table


def sql_rows(duck, sql, *columns):
    found = duck.execute(sql)
    at = [[d[0] for d in found.description].index(c) for c in columns]
    return [tuple(row[i] for i in at) for row in found.fetchall()]


def test_quality_query_equals_its_sql(spark, sample, duck):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_rate", "kept"]
    rows = queries.op5_quality_rules(spark, sample)
    assert sorted(rows.columns) == sorted(columns)
    got = sorted(tuple(r[c] for c in columns) for r in rows.collect())
    assert got == sorted(sql_rows(duck, queries.QUALITY_SQL, *columns))
    assert {r[-1] for r in got} == {True, False}


def test_quality_of_odd_rows(spark):
    good = " ".join(f"word{i}" for i in range(40))
    docs = [(1, good, "a", "x"), (1, good, "a", "x"), (2, None, "a", "x"), (3, "", None, "x"), (4, "same words here again now and then so " * 4, "b", "x"),
            (None, good + "\n#one\n\n\n#one\n \n#one", "a", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, host string")
    rows = {(r.doc_id, r.host): r for r in quality.judge(df).collect()}
    assert rows[(2, "a")].n_words == rows[(3, None)].n_words == 0 and rows[(2, "a")].base_failed
    assert rows[(4, "b")].n_repeat_words == rows[(4, "b")].n_words == 32 and rows[(4, "b")].base_failed
    assert (rows[(None, "a")].n_dup_lines, rows[(None, "a")].n_symbols) == (2, 3)
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "None"]
    assert quality.judge(df.limit(0)).collect() == []


def test_pipeline_equals_a_plain_one(spark, sample, duck):
    kept = dict(sql_rows(duck, queries.QUALITY_SQL, "doc_id", "kept"))
    docs = [(r.doc_id, r.text) for r in read_table(spark, sample, "documents").collect()]
    stage = read_table(spark, sample, "documents")
    columns, plain, sizes = stage.columns, docs, []
    for name, function in corpus_pipeline.STAGES[:-1]:
        if name == "quality_rules":
            plain = [d for d in plain if kept[d[0]]]
        elif name == "line_dedup":
            plain = [new for old, new in zip(plain, plain_blocks(plain)) if new == old or (new[1] or "").split()]
        elif name == "near_duplicates":
            stays = {(i, c) for i, _, c in plain_components(plain)}
            plain = [d for d in plain if (str(d[0]), str(d[0])) in stays]
        else:
            marks = plain_marks([(t or "").encode() for _, t in plain], corpus_pipeline.PASSAGE)
            plain = [(i, np.frombuffer((t or "").encode(), np.uint8)[~m].tobytes().decode("utf-8", "replace")) for (i, t), m in zip(plain, marks)]
        stage = function(spark, stage, sample)
        assert stage.columns == columns
        rows = stage.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == sorted(plain)
        assert all(r.n_chars == len(r.text) for r in rows)
        sizes.append((len(plain), sum(len(t) for _, t in plain)))
        stage = spark.createDataFrame(rows, stage.schema)
    assert all(a > b for (_, a), (_, b) in zip(sizes, sizes[1:])) and sizes[0][0] > sizes[2][0]
    rows = corpus_pipeline.run(spark, sample).collect()
    lengths = {}
    for r in rows:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.n_tokens
    assert lengths == {i: len(t.encode().split()) for i, t in plain}
    assert len({(r.bucket_length, r.batch, r.slot) for r in rows}) == len(rows)
    assert max(r.n_tokens for r in rows) <= packing.Shape().max_length


def test_other_queries_equal_their_sql(spark, sample, duck):
    for name in ("op4_ngram_jaccard", "op6_suffix_array_dedup", "op7_substring_dedup"):
        rows = queries.QUERIES[name](spark, sample)
        got = sorted(map(tuple, rows.collect()), key=str)
        assert got == sorted(sql_rows(duck, queries.ORACLES[name], *rows.columns), key=str), name


def test_pipeline_takes_passages_of_over_fifty_words(spark, sample):
    numbers = iter(np.random.default_rng(8).permutation(np.arange(10**4, 10**5)).tolist())  # no word twice
    words = lambda n: [str(next(numbers)) for _ in range(n)]
    passages = [words(n) for n in range(51, 61)]
    texts = [" ".join([*words(80), *p, *words(80)]) for p in passages for _ in range(2)]
    df = spark.createDataFrame([(i, t, "en", f"host{i % 3}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, function in corpus_pipeline.STAGES[:-1]:
        df = function(spark, df, sample)
    left = {r.doc_id: r.text.split() for r in df.collect()}
    assert sorted(left) == list(range(20))
    for i, own in left.items():
        assert 159 <= len(own) <= 162 and not set(passages[i // 2][1:-1]) & set(own)


def test_pipeline_of_odd_rows(spark, sample):
    rng = np.random.default_rng(3)
    text = lambda: "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 10**6, 9)) for _ in range(6))
    one, two, three = text(), text(), text()
    head = one.split("\n")[0] + "\n"
    rows = [(1, one), (1, one), (2, None), (3, ""), (None, two), (None, two), (None, None), (4, head + three), (5, three), (6, one), (7, "\n".join(text() for _ in range(300)))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, row int, n_words int, spans array<int>"
    docs = spark.createDataFrame([(i, t, "en", f"host{k}", len(t or ""), "k", 1, 2, [3]) for k, (i, t) in enumerate(rows)], schema)
    for start in (docs, docs.limit(0)):
        df, sizes = start, []
        for _, function in corpus_pipeline.STAGES[:-1]:
            df = spark.createDataFrame(function(spark, df, sample).collect(), df.schema)
            assert df.dtypes == start.dtypes
            sizes.append(df.count())
        packed = corpus_pipeline.STAGES[-1][1](spark, df, sample).collect()
        if start is docs:
            kept = {r.doc_id: r.text for r in df.collect()}
            assert sorted(map(str, kept)) == ["1", "4", "7", "None"] and kept[1] == one and kept[None] == two
            assert sizes[0] == 8 and sizes[1] == 6 and sizes[2] == 4  # 5 and 6 lose all their words to 4 and 1
            assert {r.doc_id for r in packed} == set(kept) and min(r.n_tokens for r in packed) > 0
        else:
            assert sizes == [0] * 4 and packed == []
