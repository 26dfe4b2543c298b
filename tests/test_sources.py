import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from loamwork.operators import evaluate, index
from loamwork.sources import readers, sinks
from loamwork.streaming import documents


def test_files(spark, tmp_path):
    for i in (1, 3):
        (tmp_path / str(i)).mkdir()
        (tmp_path / str(i) / "final.md").write_text(f"# doc {i}\nbody")
    docs = readers.read_documents(spark, f"{tmp_path}/{{doc_id}}/final.md", [1, 2, 3])
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {1: "# doc 1\nbody", 3: "# doc 3\nbody"}
    guides = tmp_path / "guides"
    guides.mkdir()
    for name, text in (("a.md", "x"), ("README.md", "y"), ("blank.md", " \n"), ("b.PDF", "p")):
        (guides / name).write_text(text)
    assert [r["stem"] for r in readers.read_markdown_folder(spark, str(guides)).collect()] == ["a"]
    assert [r["name"] for r in readers.list_files(spark, str(guides)).collect()] == ["b.PDF"]


def test_jsonl_and_rules(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text('{"id": "a", "chapter": "c", "density": "high", "tags": ["t"]}\n\n{"id": "b", "chapter": "c", "density": "low"}\n')
    assert [r["id"] for r in readers.read_fragments(spark, str(path), ["c"], ["high"]).collect()] == ["a"]
    assert readers.rule_rows(spark).where("tier = 'exact'").count() > 10
    (tmp_path / "a.json").write_text('[{"seq": 1, "name": "x"}, {"seq": 2, "name": "y"}]')
    assert {r["name"] for r in readers.read_json_array(spark, f"{tmp_path}/a.json", readers.ENTITY).collect()} == {"x", "y"}


def test_metrics_files(spark, tmp_path):
    for name, value in (("a", 0.5), ("b", 0.75)):
        (tmp_path / f"result_{name}.json").write_text(json.dumps({"model_name": f"org/{name}", "model_short": name, "mrr_at_1": 0.1, "mrr_at_3": value, "hit_at_1": 0.2, "hit_at_3": 0.3, "hit_at_10": 0.4, "mrr_by_chapter": {}}))
    (tmp_path / "other.json").write_text("{}")
    metrics = readers.read_metrics(spark, str(tmp_path))
    assert [(r["model"], r["mrr_3"], r["hit_10"]) for r in evaluate.best_models(metrics).collect()] == [("b", 0.75, 0.4), ("a", 0.5, 0.4)]
    report = sinks.metrics_report(metrics, title="Embeddings")
    assert report.startswith("# Embeddings") and "best: b, MRR@3 0.7500" in report


def test_inputs_and_settings(spark, tmp_path, monkeypatch):
    (tmp_path / "one.PDF").write_bytes(b"1")
    (tmp_path / "two.txt").write_bytes(b"2")
    assert [r["name"] for r in readers.read_input(spark, str(tmp_path)).collect()] == ["one.PDF"]
    assert bytes(readers.read_input(spark, f"{tmp_path}/one.PDF").first()["content"]) == b"1"
    monkeypatch.setenv("LOAM_SIZE", "9")
    assert readers.options("LOAM_", {"size": "1", "name": "x"}) == {"size": "9", "name": "x"}

    def converter():
        return lambda content: content.decode() + "!"

    files = spark.createDataFrame([("a", b"x"), ("b", b"\xff")], "path string, content binary")
    got = {r["path"]: (r["text"], r["error"] is None) for r in readers.convert_files(files, converter).collect()}
    assert got == {"a": ("x!", True), "b": (None, False)}


def test_index_upsert(spark, tmp_path):
    kind = "collection string, file_id long, body string"
    index.upsert(spark.createDataFrame([("a", 1, "old"), ("b", 2, "stays")], kind), f"{tmp_path}/i")
    index.upsert(spark.createDataFrame([("a", 1, "new"), ("a", 3, "more")], kind), f"{tmp_path}/i")
    assert {(r["file_id"], r["body"]) for r in readers.open_index(spark, f"{tmp_path}/i").collect()} == {(1, "new"), (2, "stays"), (3, "more")}


def test_reports_and_graph_files(spark, tmp_path):
    titles = spark.createDataFrame([(1, 0, "甲", 1), (1, 1, "乙管理", 2), (2, 0, "甲（一）", 1), (2, 1, "丙", 1)], "doc_id int, pos int, title string, level int")
    report = sinks.structure_report(titles)
    assert "## optional" in report and "| 甲 | 2 | 2 | 2 |" in report
    mapped = spark.createDataFrame([(1, 0, "x", "A", "exact"), (1, 1, "y", "unmapped", "unmapped")], "doc_id int, pos int, title string, chapter_id string, match_type string")
    assert "| unmapped | 1 | 1 | y |" in sinks.coverage_text(mapped)
    fragments = spark.createDataFrame([("high", "c", "e", 1)], "density string, chapter string, engineering_type string, source_doc int")
    assert "total: 1" in sinks.fragment_report(fragments, titles)
    entities = spark.createDataFrame([(i, f"id{i}", "t", "e", f"n{i}") for i in range(7)], "seq long, id string, type string, engineering_type string, name string")
    relations = spark.createDataFrame([(1, "r")], "seq long, relation_type string")
    graph = sinks.graph_report(entities, relations)
    assert "n4" in graph and "n5" not in graph
    sinks.write_graph(entities, relations, f"{tmp_path}/g")
    nodes, edges = readers.open_graph(spark, f"{tmp_path}/g")
    assert (nodes.count(), edges.count()) == (7, 1)
    sinks.write_candidates(spark.createDataFrame([(1, 2, 9, 0.5), (1, 1, 8, 0.7)], "query_id int, rank int, id int, score double"), f"{tmp_path}/c")
    assert [c["id"] for c in spark.read.json(f"{tmp_path}/c").first()["candidates"]] == [8, 9]
    stages = spark.createDataFrame([(1, "raw", "a"), (1, "final", "b")], "doc_id int, stage string, text string")
    sinks.write_stages(stages, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s/stage=final").first()["text"] == "b"


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("x.txt", "no")
        z.writestr("y.md", "# yes")
    files = spark.createDataFrame([(buffer.getvalue(),), (b"broken",), (None,)], "content binary")
    assert [r["text"] for r in readers.unpack_markdown(files).collect()] == ["# yes", None, None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "c1", "x"), ("b", "c2", "中")], "file_id string, collection string, body string")
    sinks.write_index(rows, f"{tmp_path}/index")
    assert readers.open_index(spark, f"{tmp_path}/index").where("collection = 'c2'").first()["body"] == "中"
    sinks.write_jsonl(rows, f"{tmp_path}/json", single=True)
    assert "中" in "".join(p.read_text() for p in (tmp_path / "json").glob("part-*"))
    sinks.append_task_log(spark, {"a": 1}, f"{tmp_path}/log")
    sinks.append_task_log(spark, {"a": 2}, f"{tmp_path}/log")
    assert spark.read.text(f"{tmp_path}/log").count() == 2
    with pytest.raises(RuntimeError):
        sinks.log_message("ERROR", "stop")
    report = sinks.markdown_table(rows.select("file_id", F.lit(None).cast("string").alias("none")))
    assert report.splitlines()[0] == "| file_id | none |"


def test_stream_equals_batch(spark, small, tmp_path):
    path = f"{small}/documents.parquet"
    batch = spark.read.parquet(path)
    folder = tmp_path / "in"
    batch.repartition(3).write.parquet(str(folder))
    schema = ", ".join(f"{n} {t}" for n, t in batch.dtypes)
    stream = documents.clean_stream(documents.read_stream(spark, str(folder), schema, 1))
    documents.start(stream.select("doc_id", "cleaned", "checks"), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = documents.clean_stream(batch).select("doc_id", "cleaned", "checks")
    assert sorted(map(tuple, got.select("doc_id", "cleaned").collect())) == sorted(map(tuple, want.select("doc_id", "cleaned").collect()))
