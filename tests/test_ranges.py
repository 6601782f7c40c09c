"""Ranges of files are gathered into tasks, so that small ones do not cost a task each."""

import hashlib

from tidemark.sources import adapter
from tidemark.sources.adapter import range_digests, register_folders, tree_digests


def test_small_ranges_share_tasks(spark, tmp_path):
    files = {f"f{i}": bytes([i]) * (1000 * i) for i in range(20)}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    register_folders(spark)
    found = spark.read.format("folder").option("content", "ranges").option("size", "500").load(str(tmp_path))
    assert found.rdd.getNumPartitions() == 1
    want = {(n, at): hashlib.sha256(d[at : at + 500]).hexdigest() for n, d in files.items() for at in range(0, max(1, len(d)), 500)}
    assert {(r["path"], r["start"]): r["digest"] for r in range_digests(found, 500).collect()} == want
    assert {r["path"]: r["size"] for r in tree_digests(range_digests(found, 500)).collect()} == {n: len(d) for n, d in files.items()}


def test_tasks_have_a_size():
    ranges = [adapter.Range("a", 99 << 20, None, at << 20, (at + 1) << 20) for at in range(99)] + [adapter.Range("b", 0, None, 0, 0)] * 2500
    tasks = adapter.dealt(iter(ranges))
    assert [r for t in tasks for r in t.ranges] == ranges
    assert all(sum(r.end - r.start for r in t.ranges) <= adapter.TASK_BYTES and len(t.ranges) <= adapter.TASK_RANGES for t in tasks) and len(tasks) == 9
    assert len(adapter.dealt(iter([adapter.Range("a", 1 << 40, None, i << 30, (i + 1) << 30) for i in range(4)]))) == 4
