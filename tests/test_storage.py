"""Sources, sinks and streams."""

import json

from conftest import values

from termloom.operators import index
from termloom.sources import documents, index_store
from termloom.streaming import postings as stream


def test_uploads(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a/one.txt").write_bytes(b"first\xff text")
    (tmp_path / "b/one.txt").write_text("second")
    (tmp_path / "b/two.csv").write_text("id,text\n1,x\n")
    (tmp_path / "b/none.txt").write_text("")
    got = {r.doc_id: r.text for r in documents.read_uploads(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()}
    assert got == {"one.txt": "first text", "two.csv": "id,text\n1,x\n"}
    assert values(documents.read_rows(spark, str(tmp_path / "b/two.csv"), "id", "text"), "doc_id", "text") == [("1", "x")]


def test_upsert_and_clear(spark):
    docs = documents.sample_documents(spark)
    new = spark.createDataFrame([("sample0.txt", "other", 9), ("more", "x", 10)], documents.FORM)
    got = {r.doc_id: r.text for r in documents.upsert(docs, new).collect()}
    assert got["sample0.txt"] == "other" and len(got) == 9
    assert documents.clear(docs).count() == 0


def test_index_round_trips(spark, tmp_path):
    postings = index.build_inverted_index(documents.sample_documents(spark))
    index_store.save_index(postings, str(tmp_path / "p"))
    assert values(index_store.load_index(spark, str(tmp_path / "p"))) == values(postings)
    index_store.export_json(postings, str(tmp_path / "j"))
    assert values(index_store.import_json(spark, str(tmp_path / "j"))) == values(postings)
    index_store.export_json(postings.drop("tf"), str(tmp_path / "s"))
    assert values(index_store.import_json(spark, str(tmp_path / "s")), "term", "doc_id") == values(postings, "term", "doc_id")
    (tmp_path / "whole.json").write_text(json.dumps({"a": {"d1": 2}, "b": ["d1", "d2"]}, indent=2))
    assert values(index_store.import_json(spark, str(tmp_path / "whole.json"), whole=True)) == [("a", "d1", 2), ("b", "d1", None), ("b", "d2", None)]


def test_index_as_one_object(spark, tmp_path):
    rows = [('a"b', "d1", 2), ('a"b', "d2", 1), ("zoë", "d1", 1), ("b\\n", "d3", 4), ("", "d1", 1)]
    postings = spark.createDataFrame(rows, "term string, doc_id string, tf long").repartition(3)
    index_store.export_json(postings, str(tmp_path / "o"), whole=True)
    (part,) = (tmp_path / "o").glob("part-*.txt")
    assert json.loads(part.read_text()) == {'a"b': {"d1": 2, "d2": 1}, "zoë": {"d1": 1}, "b\\n": {"d3": 4}, "": {"d1": 1}}
    assert values(index_store.import_json(spark, str(tmp_path / "o"), whole=True)) == sorted(rows, key=repr)
    index_store.export_json(postings.drop("tf"), str(tmp_path / "l"), whole=True)
    (part,) = (tmp_path / "l").glob("part-*.txt")
    assert json.loads(part.read_text())['a"b'] == ["d1", "d2"]
    index_store.export_json(postings.where("false"), str(tmp_path / "e"), whole=True)
    (part,) = (tmp_path / "e").glob("part-*.txt")
    assert json.loads(part.read_text()) == {}


def test_an_object_is_read_by_its_lines(spark, tmp_path):
    """What is written an entry a line is never one row; what is laid out otherwise is read all the same."""
    rows = [(f't{k} "x, {{"', f"d{i}", k + i + 1) for k in range(40) for i in range(5)]
    index_store.export_json(spark.createDataFrame(rows, "term string, doc_id string, tf long"), str(tmp_path / "o"), whole=True)
    got = index_store.import_json(spark, str(tmp_path / "o"), whole=True)
    assert values(got) == sorted(rows, key=repr) and "wholetext" not in got._jdf.queryExecution().toString().lower()
    assert index_store._entries_by_line(spark, str(tmp_path / "o")).count() == 40
    made = {"a": {"d1": 2, "d2": 1}, "b": ["d1", "d,2"], "c": {}}
    want = [("a", "d1", 2), ("a", "d2", 1), ("b", "d,2", None), ("b", "d1", None)]
    layouts = [json.dumps(made), json.dumps(made, indent=1), json.dumps(made, separators=(",\n", ":")), "{\n" + ",\n".join(f"{json.dumps(k)}: {json.dumps(v)}" for k, v in made.items()) + "\n}", '{"a":\n{"d1":2,\n"d2":1},"b":["d1","d,2"]}']
    for k, text in enumerate(layouts):
        (tmp_path / f"{k}.json").write_text(text)
        assert values(index_store.import_json(spark, str(tmp_path / f"{k}.json"), whole=True)) == want, text


def test_streamed_windows(spark, tmp_path):
    import datetime as dt

    source, at = str(tmp_path / "in"), lambda h, m: dt.datetime(2024, 5, 1, h, m)
    run = lambda rows: (
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(source),
        stream.start_windows(spark.readStream.schema("ts timestamp, kind string").parquet(source), "ts", "kind", str(tmp_path / "out")).awaitTermination(),
    )
    run([(at(1, 5), "a"), (at(1, 50), "a"), (at(2, 0), "b"), (None, "c")])
    run([(at(1, 10), "a"), (at(9, 0), None)])  # late, but within the two hours
    got = {(r.start.hour, r.kind): r.n for r in stream.read_windows(spark, str(tmp_path / "out")).collect()}
    assert got == {(1, "a"): 3, (2, "b"): 1, (9, None): 1}


def test_streamed_postings(spark, tmp_path):
    source = str(tmp_path / "in")
    run = lambda rows: (
        spark.createDataFrame(rows, "doc_id string, text string").write.mode("append").parquet(source),
        stream.start(spark.readStream.schema("doc_id string, text string").parquet(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(),
    )
    run([("a", "cat cat dog"), ("b", "dog"), ("c", "bird")])
    run([("b", "fish"), ("c", None)])
    assert values(stream.read(spark, str(tmp_path / "out"))) == [("cat", "a", 2), ("dog", "a", 1), ("fish", "b", 1)]


def test_scratch_is_shared_and_cleaned(spark):
    import os

    from termloom.session import clean_scratch, shared_dir, stored

    assert shared_dir(spark).startswith("file:")
    assert values(stored(spark.range(3), "x")) == [0, 1, 2]
    assert spark.sparkContext.applicationId in stored(spark.range(3), "y").inputFiles()[0]
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/termloom"
    assert os.path.isdir(folder)
    clean_scratch(spark)
    assert not os.path.exists(folder)
