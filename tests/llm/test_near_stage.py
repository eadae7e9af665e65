"""The pipeline's near stage joins what fingerprints and what shingles link."""

import corpus_pipeline
from pagewarden.llm import near_dedup, simhash


def test_both_kinds_of_links(spark):
    """Fingerprints count repeats, sets of shingles don't: a verse sung 200 times with two endings is linked by the former alone."""
    verse = "one two three four five six seven " * 200
    ending = lambda c: " ".join(f"{c}{i}" for i in range(20))
    plain = [f"w{i}" for i in range(100)]
    other = [*plain[:50], "x", *plain[51:]]
    rows = [(1, verse + ending("a")), (2, verse + ending("b")), (3, " ".join(plain)), (4, " ".join(other)), (5, "nothing like it"), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda found: {r["doc_id"]: r["component_id"] for r in found.collect()}
    assert by(near_dedup.find_components(docs)) == {1: 1, 2: 2, 3: 3, 4: 3, 5: 5, 6: 6}
    assert by(simhash.find_components(docs)) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    kept = corpus_pipeline.near(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3, 5, 6]
