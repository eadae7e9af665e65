"""The sliced two-pass filter: no repeated key is lost, few others pass, and plans do not grow with the slices."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagewarden.llm import _bloom, _families, exact_dedup, line_dedup, near_dedup
from pagewarden.llm._common import written


@pytest.mark.parametrize("slice_keys", [100, 5_000_000])
def test_repeated_keys_are_found(spark, slice_keys):
    rng = random.Random(1)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(30_000)]
    keys += rng.sample(keys, 500) + [keys[7]] * 2000
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(9)
    got = [r["key"] for r in _bloom.possibly_repeated(df, lambda b: b.column("k").to_numpy(), len(keys), slice_keys).collect()]
    again = {k for k, n in Counter(keys).items() if n > 1}
    assert len(got) == len(set(got)) and again <= set(got) <= set(keys) and len(got) < len(again) + 0.2 * len(set(keys))
    assert _bloom.possibly_repeated(df.where("false"), lambda b: b.column("k").to_numpy(), 0, slice_keys).collect() == []


def test_a_filter_holds_its_keys(spark):
    rng = random.Random(2)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(3000)]
    for cells in (1 << 10, 1 << 16):
        bits = _bloom.bits_of(spark.createDataFrame([(k,) for k in keys], "key long"), cells)
        assert all(_bloom.is_set(bits, at).all() for at in _bloom.cells_of(np.array(keys), cells))
    other = np.array([rng.getrandbits(64) - 2**63 for _ in range(10_000)])
    one, two = _bloom.cells_of(other, 1 << 16)
    assert (_bloom.is_set(bits, one) & _bloom.is_set(bits, two)).mean() < 0.05


def test_dealt_keys_are_whole():
    keys = np.array([5, 5, -3, 8, 2**62], np.int64)
    batch = next(iter(_bloom._deal(lambda b: b.column(0).to_numpy(), 7)(iter([pa.RecordBatch.from_arrays([pa.array(keys)], names=["k"])]))))
    out = {}
    for s, k, a in zip(*(batch.column(i).to_pylist() for i in range(3))):
        own = np.frombuffer(k, np.int64)
        out |= dict(zip(own.tolist(), np.unpackbits(np.frombuffer(a, np.uint8), count=len(own)).tolist()))
        assert ((own.view(np.uint64) >> np.uint64(32)) * np.uint64(7) >> np.uint64(32) == s).all()
    assert out == {5: 1, -3: 0, 8: 0, 2**62: 0}


def plan_of(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return {w: text.count(w) for w in ("Scan parquet", "BroadcastExchange", "MapInArrow", "MapInPandas", "Union")}


def test_plans_and_rows_are_the_same_for_many_slices(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    runs = []
    for rows, keys in ((4_000_000, 4_000_000), (5, 50)):
        monkeypatch.setattr(exact_dedup, "SLICE_ROWS", rows)
        monkeypatch.setattr(_families, "BLOOM_KEYS", keys)
        found = [exact_dedup.find_duplicates(docs), exact_dedup.drop_duplicates(docs), line_dedup.count_lines(docs), near_dedup.find_components(docs)]
        runs.append(([plan_of(f) for f in found], [Counter(str(r) for r in f.collect()) for f in found]))
    assert runs[0] == runs[1]


def test_a_full_filter_changes_no_row(spark, sf, monkeypatch):
    """With far more keys than the filters serve, rows pass them in vain, and results stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = [Counter(map(str, f(docs).collect())) for f in (exact_dedup.find_duplicates, line_dedup.count_lines, near_dedup.find_components)]
    monkeypatch.setattr(exact_dedup, "FILTER_ROWS", 1)
    monkeypatch.setattr(exact_dedup, "SEGMENT_CELLS", 64)
    monkeypatch.setattr(_families, "MOST_CELLS", 64)
    assert [Counter(map(str, f(docs).collect())) for f in (exact_dedup.find_duplicates, line_dedup.count_lines, near_dedup.find_components)] == want


def test_a_written_key_table_is_read_once(spark):
    keys = written(spark.range(1000).selectExpr("xxhash64(id % 900) AS k"), "keys")
    out = _bloom.possibly_repeated(keys, lambda b: b.column("k").to_numpy(), 1000, 10)
    assert plan_of(out)["Scan parquet"] == 1 and {r["key"] for r in out.collect()} >= {r["k"] for r in keys.groupBy("k").count().where("count > 1").collect()}
