"""Positions from files and footers, and which files a scan opens."""

import pytest
from gristmill.operators import corpus
from gristmill.sources.positions import OrderedFiles, batches, sorted_files
from pyspark.sql import functions as F


@pytest.fixture
def folder(spark, tmp_path):
    """Eight files of 5, 0, 10, ... rows; the text tells the position."""
    at = 0
    for k, n in enumerate([5, 0, 10, 3, 40, 1, 20, 7]):
        df = spark.range(at, at + n, 1, 1).selectExpr("cast(id * 7 % 1000 as string) AS id", "repeat('x', 4) AS text", "id AS true_pos")
        df.write.parquet(str(tmp_path / "w"), mode="overwrite")
        (part,) = (tmp_path / "w").glob("part-*.parquet")
        (tmp_path / "source").mkdir(exist_ok=True)
        part.rename(tmp_path / "source" / f"shard {k:02}.parquet")
        at += n
    (tmp_path / "source" / "_SUCCESS").touch()
    (tmp_path / "source" / "notes.txt").touch()
    return str(tmp_path / "source")


def opened(df):
    return sorted(f.rsplit("/", 1)[-1].replace("%20", " ") for f in df.inputFiles())


def test_positions_are_those_of_the_rows(spark, folder):
    files = OrderedFiles(spark, folder)
    assert [f.rsplit("/", 1)[-1] for f in files.files] == [f"shard {k:02}.parquet" for k in range(8)]
    every = files.after(0)
    assert every.count() == 86 and every.where("pos <> true_pos").isEmpty()
    assert set(every.columns) == {"id", "text", "true_pos", "pos"}
    assert sorted_files(spark, files.files[3]) == [files.files[3]]


@pytest.mark.parametrize(("n", "last"), [(0, 0), (1, 0), (5, 0), (6, 2), (15, 2), (16, 3), (58, 4), (86, 7), (1000, 7)])
def test_files_beyond_the_target_stay_closed(spark, folder, n, last):
    files = OrderedFiles(spark, folder)
    got = files.first(n)
    assert sorted(r["true_pos"] for r in got.collect()) == list(range(min(n, 86)))
    assert opened(got)[-1] == f"shard {last:02}.parquet" and files.counted <= max(1, 2 * last + 1)


def test_what_follows_a_position(spark, folder):
    for n in (0, 4, 5, 17, 18, 85, 86, 900):
        files = OrderedFiles(spark, folder)
        assert sorted(r["true_pos"] for r in files.after(n).collect()) == list(range(min(n, 86), 86))
    after = OrderedFiles(spark, folder).after(18)
    assert opened(after)[0] == "shard 04.parquet"


def test_a_budget_opens_as_few_files_as_it_takes(spark, folder):
    files = OrderedFiles(spark, folder)
    source = files.until(6, F.length("text") / 4, 20.0)
    assert opened(source) == [f"shard {k:02}.parquet" for k in (2, 3, 4)] and files.counted < 8
    got = corpus.stream_after_skip(source, 6, 20.0, "clean")
    assert sorted(r["pos"] for r in got.collect()) == list(range(6, 26))
    assert OrderedFiles(spark, folder).until(80, F.length("text") / 4, 1000.0).count() == 6


def test_pieces(spark, folder):
    files = OrderedFiles(spark, folder)
    assert [sorted(r["true_pos"] for r in b.collect()) for b in batches(files, 30)] == [list(range(0, 30)), list(range(30, 60)), list(range(60, 86))]
