import json

from textloom.sources import files, sinks, submissions


def test_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.htm").write_bytes(b"<p>x")
    (tmp_path / "raw/a.html").write_bytes(b"<p>y")
    (tmp_path / "raw/b.txt").write_text("z\nw")
    assert sorted((r.filename, bytes(r.content)) for r in files.raw_filings(spark, str(tmp_path / "raw")).collect()) == [("a.htm", b"<p>x"), ("a.html", b"<p>y")]
    assert [(r.stem, r.text) for r in files.clean_texts(spark, [str(tmp_path / "raw")]).collect()] == [("b", "z\nw")]
    (tmp_path / "list").write_text("a\n\n b \n")
    assert [r.path for r in files.path_list(spark, str(tmp_path / "list")).collect()] == ["a", "b"]
    (tmp_path / "master.idx").write_text("head\nCIK|x\n-----\n1|A|10-K|2020-01-02|f.txt\n2|B\n")
    assert files.master_index(spark, str(tmp_path / "master.idx")).count() == 2


def test_submissions(spark):
    recent = {"accessionNumber": ["1", "2", "3"], "form": ["10-K", "8-K", "8-K"], "filingDate": ["2020-01-02", "bad", "2019-01-01"], "primaryDocument": ["a.htm", "", ""]}
    feed = spark.createDataFrame([("7", json.dumps({"filings": {"recent": recent, "files": [{"name": "p.json"}]}}))], "cik string, json string")
    pages = spark.createDataFrame([("7", 1, json.dumps({"accessionNumber": ["0"], "form": ["10-K"], "filingDate": ["2018-01-01"]}))], "cik string, page int, json string")
    rows = submissions.paged_filings(feed, pages).orderBy("page", "nth").collect()
    assert [(r.accession_no, r.page, r.primary_doc) for r in rows] == [("1", 0, "a.htm"), ("3", 0, None), ("0", 1, None)]
    assert [(r.page, r.name) for r in submissions.page_names(feed).collect()] == [(1, "p.json")]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "stem string, text string")
    sinks.write_texts(docs, str(tmp_path / "t"))
    sinks.write_texts(docs.union(spark.createDataFrame([("c", "z")], docs.schema)), str(tmp_path / "t"))
    assert sorted(r.stem for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b", "c"]
    card, config = sinks.model_card({"name": "m"})
    assert card.startswith("# m") and json.loads(config)["eos_token"] == "<|endoftext|>"
