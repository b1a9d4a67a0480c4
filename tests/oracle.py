import glob
import os

import duckdb


def same(spark, query, sql: str, sf_dir: str) -> None:
    """The query's rows equal the SQL's, by column name and in any order."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    rel = db.sql(sql)
    assert sorted(rel.columns) == names
    at = [rel.columns.index(c) for c in names]
    theirs = sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or (isinstance(x, float) and abs(x - y) <= 1e-9 * max(1, abs(x))), (a, b)
