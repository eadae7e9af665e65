"""Work that no task holds whole: pages are parsed in small pieces, and tasks are not dealt by their words."""

import pyarrow as pa

from pagewarden.functions import pii
from pagewarden.operators import pages, profile
from pyspark.sql import functions as F


def test_pages_are_parsed_in_pieces():
    html = '<p>one</p><a href="/x" title="t">two</a>'
    got = list(pages._parse([pa.RecordBatch.from_pydict({"page_id": list(range(500)), "html": [html if i % 5 else None for i in range(500)]})]))
    assert max(b.num_rows for b in got) <= 3 * pages.PARSED and sum(b.num_rows for b in got) == 400 * 3
    first = [r for b in got for r in b.to_pylist() if r["kind"] == "element"][0]
    assert first == {"page_id": 1, "kind": "element", "pos": 1, "tag": "a", "attributes": [("href", "/x"), ("title", "t")], "text": "two", "for_label": None, "labelled_by": None, "parent": -1}


def test_tasks_are_not_dealt_by_words(spark):
    tasks = spark.createDataFrame([(1, "Fill the form for Aunt May."), (2, "Fill the form for me.")], "task_id int, task string")
    people = spark.createDataFrame([(1, "Me", True, 0), (3, "May", False, 2), (4, "Aunt May", False, 3)], "person_id int, name string, active boolean, pos int")
    picked = profile.pick_person(tasks, people)
    assert "hashpartitioning(_word" not in picked._jdf.queryExecution().executedPlan().toString()
    assert {r.task_id: r.person_id for r in picked.collect()} == {1: 4, 2: 1}


def test_values_beside_each_other_by_the_contracts_rules(spark):
    """The SQL counts 0 and 1 here: its stand-in for a look-behind takes what the next value needs."""
    texts = ["+1 (921) 555-8394 69.186.48.130 59.36.80.30 5543404633219280", "230.92.119.79\n56.187.231.175\n196.3.67.149\n\"b64\""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", F.expr("i").alias("k"), pii.pii_spans(F.col("t")).alias("s")).collect()
    assert {r.i: [texts[r.i][x.start : x.end] for x in r.s] for r in got} == {0: ["130 59.36.80.30"], 1: ["230.92.119.79\n56", "187.231.175\n196"]}
