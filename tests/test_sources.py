"""Readers, writers and the streaming forms of incremental steps."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from gristmill.operators.evaluate import nested
from gristmill.sources import readers, writers
from gristmill.streaming import incremental
from pyspark.sql import functions as F


def test_annotations_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('\ufefftext,id\n"two\nlines, ""quoted""",<urn:uuid:1>\nplain,2\n', encoding="utf-8")
    rows = readers.annotations(spark, str(path), "vi").collect()
    assert [(r["text"], r["id"], r["language"]) for r in rows] == [('two\nlines, "quoted"', "<urn:uuid:1>", "vi"), ("plain", "2", "vi")]


def test_word_list(spark, tmp_path):
    path = tmp_path / "words.txt"
    path.write_text("# comment\n\nBad-Word\n***\nworse\nworse\n")
    assert readers.word_list(spark, str(path)) == ["badword", "worse"]


def test_files_as_buckets(spark, tmp_path):
    for name in ("vi", "th"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"context": name, "choices": ["A"], "choice_texts": ["x"], "gold": 0}, ensure_ascii=False) + "\n")
    got = readers.by_file(spark, str(tmp_path), readers.MCQ, "bucket")
    assert {(r["context"], r["bucket"]) for r in got.collect()} == {("vi", "vi"), ("th", "th")}
    assert readers.by_file(spark, str(tmp_path), readers.MCQ, "bucket", ["vi"]).count() == 1


def test_missing_documents(spark, tmp_path):
    assert readers.whole_json(spark, str(tmp_path / "none.json"), "a int").isEmpty()
    (tmp_path / "one.json").write_text('[\n{"a": 1}\n]')
    assert readers.whole_json(spark, str(tmp_path / "one.json"), "a int").first()["a"] == 1
    with pytest.raises(Exception):
        readers.downstream(spark, str(tmp_path), "quiz", False).count()


def test_partitions_are_replaced_where_there_are_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    make = lambda rows: spark.createDataFrame(rows, "v int, language string")
    writers.partitioned(make([(1, "vi"), (2, "th")]), path, ["language"])
    writers.partitioned(make([(3, "vi")]), path, ["language"])
    assert sorted((r["v"], r["language"]) for r in spark.read.parquet(path).collect()) == [(2, "th"), (3, "vi")]


def test_keyed_appends(spark, tmp_path):
    path = str(tmp_path / "k")
    make = lambda rows: spark.createDataFrame(rows, "weight_id string, loss double")
    writers.append_keyed(make([("a", 1.0), ("b", 2.0)]), path, 0)
    writers.append_keyed(make([("a", 3.0)]), path, 1)
    assert {(r["weight_id"], r["loss"]) for r in writers.read_keyed(spark, path, "weight_id").collect()} == {("a", 3.0), ("b", 2.0)}


def test_results_store_and_stream(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    schema = "model string, task string, bucket string, metric string, value double"
    spark.createDataFrame([("m", "t", "a", "accuracy", 0.5)], schema).write.parquet(source)
    for _ in range(2):  # the second run finds nothing new
        incremental.merge_results(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "check")).awaitTermination()
    spark.createDataFrame([("m", "t", "b", "accuracy", 1.0)], schema).write.mode("append").parquet(source)
    incremental.merge_results(spark.readStream.schema(schema).parquet(source), store, str(tmp_path / "check")).awaitTermination()
    table = spark.read.parquet(store)
    assert {(r["bucket"], r["value"]) for r in table.collect()} == {("a", 0.5), ("b", 1.0)}
    assert json.loads(nested(table).first()["document"]) == {"t": {"accuracy": {"buckets": {"a": 0.5, "b": 1.0}, "macro": 0.75, "worst": 0.5}}}
    incremental.append_results(spark.readStream.schema(schema).parquet(source), str(tmp_path / "log"), str(tmp_path / "check2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_counted_scan(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) id", "'x' text", "1.0D language_score", "id pos").write.parquet(str(tmp_path / "w"))
    assert incremental.counted_scan(readers.web_source(spark, str(tmp_path / "w")), 4).count() == 4


def test_csv_and_json_lines(spark, tmp_path):
    df = spark.createDataFrame([("é", "vi")], "text string, language string")
    writers.json_lines(df, str(tmp_path / "j"), ["language"])
    assert readers.json_lines(spark, str(tmp_path / "j"), "text string, language string", language="vi").first()["text"] == "é"
    writers.csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["text"] == "é"


def test_tasks_name_all_that_is_missing(spark, tmp_path):
    rows = spark.createDataFrame([("c", ["A"], ["x"], 0, "s", "quiz", "b")], "context string, choices array<string>, choice_texts array<string>, gold int, subject string, task string, bucket string")
    writers.bucketed(rows, str(tmp_path / "docs"), ["task"])
    assert [(r["task"], r["bucket"]) for r in readers.tasks(spark, str(tmp_path / "docs"), {"quiz": ""}).collect()] == [("quiz", "b")]
    with pytest.raises(FileNotFoundError, match="sums.*more"):
        readers.tasks(spark, str(tmp_path / "docs"), {"quiz": "", "sums": "subject", "more": ""})
    with pytest.raises(ValueError):
        readers.tasks(spark, str(tmp_path / "docs"), {})


def test_folder_names(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "_hidden").mkdir()
    (tmp_path / "b.txt").touch()
    assert [tuple(r) for r in readers.folder_names(spark, str(tmp_path)).orderBy("name").collect()] == [("a", True), ("b.txt", False)]
    assert readers.folder_names(spark, str(tmp_path / "none")).isEmpty()


RUNS = "model string, task string, bucket string, metric string, value double"


def test_log_of_results(spark, tmp_path):
    path = str(tmp_path / "log")
    make = lambda rows: spark.createDataFrame(rows, RUNS)
    assert writers.logged_results(spark, path).isEmpty()
    first = make([("m", "t", "a", "accuracy", 0.5), ("m", "t", "b", "accuracy", 0.25), ("m", "held_out", "vi", "perplexity", 9.0), ("m", "held_out", "th", "perplexity", 8.0)])
    second = make([("m", "t", "b", "accuracy", 0.75), ("m", "held_out", "vi", "perplexity", 7.0)])
    assert writers.log_results(first, path, "r1", 1) and writers.log_results(second, path, "r2", 2)
    got = {(r["bucket"], r["value"], r["run"]) for r in writers.logged_results(spark, path).collect()}
    assert got == {("a", 0.5, "r1"), ("b", 0.75, "r2"), ("vi", 7.0, "r2")}  # the model's perplexities are those of its last run
    assert not writers.log_results(first, path, "r2", 3)  # a run that is there stays as it is
    assert {(r["bucket"], r["value"], r["run"]) for r in writers.logged_results(spark, path).collect()} == got
    with pytest.raises(Exception):
        writers.log_results(first.withColumn("value", F.raise_error(F.lit("no")).cast("double")), path, "r3", 3)
    assert {(r["bucket"], r["value"], r["run"]) for r in writers.logged_results(spark, path).collect()} == got


def test_runs_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    frames = [spark.createDataFrame([(f"m{k % 2}", "t", f"b{k}", "accuracy", k / 8)], RUNS) for k in range(8)]
    with ThreadPoolExecutor(8) as pool:
        assert all(pool.map(lambda k: writers.log_results(frames[k], path, f"run{k}", 0), range(8)))
    assert {(r["bucket"], r["value"]) for r in writers.logged_results(spark, path).collect()} == {(f"b{k}", k / 8) for k in range(8)}


def test_a_stream_into_the_log_can_be_replayed(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("m", "t", "a", "accuracy", 0.5)], RUNS).write.parquet(source)
    for checkpoint in ("one", "two"):  # a lost checkpoint: the first batch comes again
        incremental.log_stream(spark.readStream.schema(RUNS).parquet(source), path, "eval", str(tmp_path / checkpoint)).awaitTermination()
    assert [tuple(r) for r in writers.logged_results(spark, path).collect()] == [("m", "t", "accuracy", "a", 0.5, "eval-000000000")]
    assert spark.read.parquet(path).count() == 1
