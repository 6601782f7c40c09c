"""Merging texts holds few of them as Python's at once, however many a batch has."""

import tracemalloc

import pyarrow as pa

from tidemark.operators import textmerge


def test_a_batch_is_merged_row_by_row():
    text = [f"{i}\n" + "x" * 10_000 + "\nend\n" for i in range(2000)]
    base, a, b = (pa.array(t) for t in (text, ["A:" + t for t in text], [t + ":B" for t in text]))
    tracemalloc.start()
    out = textmerge.diff3.func(base, a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6
    assert out.field("ok").to_pylist() == [True] * 2000 and out.field("text").to_pylist() == ["A:" + t + ":B" for t in text]
    assert textmerge.diff3.func(base[:0], a[:0], b[:0]).to_pylist() == []
