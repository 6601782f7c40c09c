"""Sketches of logs: what they tell is what the anti-joins give."""

import hashlib

import pytest

from tidemark.operators.exchange import exchanged_rows, open_difference, sketch
from tidemark.operators.logset import missing_rows


def log(spark, numbers):
    return spark.createDataFrame([(hashlib.sha256(str(i).encode()).hexdigest(), f"u{i}") for i in numbers], "op string, uuid string")


@pytest.mark.parametrize(("a", "b", "told"), [
    (range(500), range(500), True), (range(500), range(1, 500), True), (range(0), range(3), True), (range(0), range(0), True),
    (range(300), range(20, 320), True), (range(300), range(200, 500), False)])
def test_as_the_anti_join(spark, a, b, told):
    x, y = log(spark, a), log(spark, b)
    for_x, for_y, opened = exchanged_rows(x, y, 120)
    ops = lambda df: sorted(tuple(r) for r in df.collect())
    assert opened == told
    assert ops(for_x) == ops(missing_rows(x, y).select("op", "uuid")) and ops(for_y) == ops(missing_rows(y, x).select("op", "uuid"))
    assert len(for_x.collect()) == len(set(b) - set(a))


def test_sketch_has_no_more_rows_than_cells(spark):
    table = sketch(log(spark, range(2000)), 30)
    assert table.count() == 30 and table.agg({"n": "sum"}).first()[0] == 6000
    assert open_difference(table, table, 30) == ([], [])
    with pytest.raises(ValueError, match="multiple"):
        sketch(log(spark, range(2)), 31)
