"""Signing of lines: empty bins, and the columns of a text's rows."""

import numpy as np
import pyarrow as pa

from pagewarden.llm import line_dedup


def test_empty_bins_take_the_first_full_bin_of_their_order():
    k = line_dedup.BANDS * line_dedup.ROWS
    rng = np.random.default_rng(3)
    minima = rng.integers(0, 2**32 - 1, (40, k), dtype=np.uint32)
    for row in range(40):  # from one full bin to all
        minima[row, rng.permutation(k)[1 + row * k // 39 :]] = line_dedup._FULL
    got = line_dedup._densified(minima.ravel(), k).reshape(-1, k)
    for row, bin_ in np.ndindex(minima.shape):
        expected = int(minima[row, bin_])
        if minima[row, bin_] == line_dedup._FULL:
            turn = next(t for t, other in enumerate(line_dedup._ORDERS[bin_]) if minima[row, other] != line_dedup._FULL)
            expected = int(minima[row, line_dedup._ORDERS[bin_, turn]]) ^ ((turn + 1) << 32)
        assert int(got[row, bin_]) == expected


def test_rows_of_texts_with_and_without_lines():
    texts = [None, "", " \n\t", "One line\n\n  Two lines  \n", "x" * 100_000, "one line"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(range(10, 16)), pa.array(texts)], names=["_row", "doc_id", "text"])
    rows = pa.Table.from_batches(line_dedup._signed([batch, batch.slice(0, 0)])).to_pylist()
    assert [(r["_row"], r["doc_id"], r["pos"], r["lines"]) for r in rows] == [
        (0, 10, None, 0), (1, 11, None, 0), (2, 12, None, 0), (3, 13, 0, 2), (3, 13, 2, None), (4, 14, 0, 1), (5, 15, 0, 1)
    ]
    assert [r["id"] is None for r in rows] == [True] * 3 + [False] * 4
    assert rows[3]["id"] == rows[6]["id"] and rows[3]["bands"] == rows[6]["bands"]
    assert all(len(r["bands"]) == 8 * line_dedup.BANDS for r in rows)
