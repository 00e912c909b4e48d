"""A query and its SQL over a table made for a test."""

from fareloom.llm import queries


def rows_of(spark, duck, name, table):
    """(columns, the query's rows, the SQL's rows) over a table of documents."""
    df = queries.QUERIES[name](spark, table)
    con = duck.cursor()
    con.execute("create or replace temp view documents as select * from read_parquet('%s/documents.parquet/*.parquet')" % table)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=repr)
    assert sorted(names) == sorted(df.columns)
    return names, got, want


def stored(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return str(folder)
