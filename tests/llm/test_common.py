"""Slices of Arrow batches."""

import pyarrow as pa

from adloom.llm import common as C


def test_slices_hold_a_megabyte_or_one_longer_row():
    texts = ["x" * n for n in [400_000] * 9 + [3_000_000] + [0, 10]] + [None]
    parts = list(C.slices(pa.RecordBatch.from_pydict({"text": texts})))
    assert [t for part in parts for t in part.column("text").to_pylist()] == texts
    sizes = [[len(t or "") for t in part.column("text").to_pylist()] for part in parts]
    assert all(sum(s) <= 1 << 20 or len(s) == 1 for s in sizes)
