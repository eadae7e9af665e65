"""Files of a row each that pass a folder of their task: all rows, few files at once, and no listing by the driver."""

import os

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from pagewarden import sources
from pagewarden.plans import rule_queries
from pagewarden.sources import named


def test_all_rows_pass_files(spark, tmp_path):
    odd = [("a/b", "x\ny\n"), (".hidden", ""), ("_é %41", "ü\r\n"), ("..", "z"), ("none", None), (None, "x"), ("", "x")]
    rows = spark.range(500).selectExpr("cast(id AS string) AS id", "concat('line ', id) AS content").unionByName(spark.createDataFrame(odd, "id string, content string"))
    back = sources.through_own_files(rows, str(tmp_path / "out"), ".txt", most=7)
    assert sorted((r.name, r.content) for r in back.collect()) == sorted([(str(i), f"line {i}") for i in range(500)] + odd[:4])
    assert not any(names or folders for _, folders, names in os.walk(tmp_path / "out"))


def test_few_files_at_once(tmp_path):
    batches = [pa.RecordBatch.from_pydict({"name": [str(i) for i in range(k, k + 30)], "content": ["x"] * 30}) for k in (0, 30, 60)]
    sizes = [b.num_rows for b in named._turns(iter(batches), str(tmp_path), ".txt", 40)]
    assert sizes == [40, 40, 10] and not os.listdir(tmp_path)


@pytest.mark.parametrize("name", ["label_files", "page_fixtures"])
def test_queries_write_in_their_tasks(spark, sf, name, tmp_path, monkeypatch):
    """Nothing is written or listed for the plan: before, the driver wrote and listed round after round."""
    monkeypatch.setattr(rule_queries, "_folder", lambda *_: str(tmp_path / "out"))
    df = entry.queries()[name](spark, sf)
    assert not (tmp_path / "out").exists()
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() > 0 and not any(names for _, _, names in os.walk(tmp_path / "out"))
