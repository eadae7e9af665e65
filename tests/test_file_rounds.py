"""Files of a row each, written and read back in rounds: all rows pass a file, and few files are there at once."""

import os

from pagewarden import sources


def test_all_rows_and_few_files_at_once(spark, tmp_path):
    rows = spark.range(500).selectExpr("id", "concat('line ', id) AS content").unionByName(spark.createDataFrame([(None, "x"), (500, None)], "id long, content string"))
    there = []

    def read(folder):
        there.append(sum(f.endswith(".txt") for _, _, names in os.walk(tmp_path) for f in names))
        return sources.read_named(spark, folder, ".txt")

    back = sources.through_files(rows, str(tmp_path / "out"), ".txt", read, most=100)
    assert sorted((int(r.name), r.content) for r in back.collect()) == [(i, f"line {i}") for i in range(500)]
    assert len(there) == 5 and sum(there) == 500 and max(there) < 150


def test_no_rows(spark, tmp_path):
    back = sources.through_files(spark.range(0).selectExpr("id", "'x' AS content"), str(tmp_path / "out"), ".txt", lambda folder: sources.read_named(spark, folder, ".txt"))
    assert back.columns == ["name", "content"] and back.count() == 0
