"""What is kept of candidates: sketches of all, texts of those alone that may be verified."""

import random

from pagewarden.llm import _common, line_dedup


def test_texts_are_kept_of_candidates_that_may_be_verified_only(spark, monkeypatch):
    tables, write, rng = {}, _common.Written.__init__, random.Random(5)

    def noted(self, df, label, partition=None):
        write(self, df, label, partition)
        tables.setdefault(label, []).append((self.df.columns, self.df.count()))

    monkeypatch.setattr(_common.Written, "__init__", noted)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for i in range(80):  # half alike: pairs share a band as often as not, and none is a link
        base = word(90)
        lines += [base + word(30), base + word(30)]
    for i in range(5):
        base = word(150)
        lines += [base, base[:-2] + "!!"]
    got = line_dedup.count_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in got if r["dropped"]) == [161, 163, 165, 167, 169]
    (columns, candidates), = tables["marks"]
    assert "text" not in columns and candidates > 50
    assert tables["texts"][0][1] < candidates / 2
    # Buckets of two have met: none is gone through again.
    assert tables["placed"][0][1] == 0
