"""Which written tables lie beside each other while line components are made: those that are still read."""

from pagewarden.llm import _common, line_dedup


def test_tables_are_deleted_once_nothing_reads_them(spark, monkeypatch):
    live, beside = {}, {}
    write, drop = _common.Written.__init__, _common.Written.drop

    def noted(self, df, label, partition=None):
        write(self, df, label, partition)
        live[self.path] = label
        beside[label] = set(live.values())

    def dropped(self):
        live.pop(self.path)
        drop(self)

    monkeypatch.setattr(_common.Written, "__init__", noted)
    monkeypatch.setattr(_common.Written, "drop", dropped)
    rows = [(i, f"the line number {i} of a family of many lines\nanother line, no. {i % 7}, that comes again") for i in range(60)]
    got = line_dedup.count_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and sum(r["dropped"] for r in got) == 53
    assert "lines" not in beside["texts"] and "bands" not in spark.read.parquet(next(p for p, x in live.items() if x == "seen")).columns
    assert not beside["texts"] & {"entries", "buckets"} and not beside["pairs"] & {"members", "placed", "wanted", "star"} and "told" not in beside["over"]
    assert not set(live.values()) & {"lines", "entries", "buckets", "members", "wanted", "texts", "star", "placed", "mixed", "told", "pairs"}
