"""The change feed as a stream with memory."""

import json
import time

import pytest

from tidemark.streaming.feed_stream import baseline_rows, stream_pages, track_changes

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def feed(spark, tmp_path):
    before = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": "2"}
    old = {k: spark.conf.get(k) for k in before}
    for k, v in before.items():
        spark.conf.set(k, v)
    (tmp_path / "pages").mkdir()
    known = spark.createDataFrame([("n1", "a.md", 5, 50), ("n2", "b.md", 6, 60)], "native string, path string, size long, mtime long")

    def page(name, *rows):
        (tmp_path / "pages" / f"{name}.ndjson").write_text("".join(json.dumps(r) + "\n" for r in rows))

    def run():
        """All pages that are there, and two looks at timers after that."""
        out, idle = [], []
        stream = track_changes(stream_pages(spark, str(tmp_path / "pages")), known)
        query = stream.writeStream.foreachBatch(lambda df, n: out.extend(tuple(r) for r in df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        began = time.time()
        while len(idle) < 2 and query.isActive and time.time() < began + 60:
            last = query.lastProgress
            if last is not None and last["numInputRows"] == 0 and last["batchId"] not in idle:
                idle.append(last["batchId"])
            time.sleep(0.2)
        query.stop()
        assert query.exception() is None
        return sorted(out, key=repr)

    yield page, run, known
    for k, v in old.items():
        spark.conf.set(k, v)


def test_changes_once(spark, feed):
    page, run, known = feed
    page("p1", {"native": "n1", "path": "a.md", "size": 5, "mtime": 50}, {"native": "n3", "path": "c.md", "size": 1, "mtime": 9}, {"native": "nx", "removed": True}, {"native": "n9", "size": 1, "mtime": 1}, {"native": "n8", "path": ".vfs/x", "size": 1, "mtime": 1}, {"path": "lost", "size": 1, "mtime": 1})
    assert run() == [("n3", "created", "c.md", None, 1, 9)]  # n1 is an echo, nx no one's, n9 nowhere
    assert run() == []
    page("p2", {"native": "n1", "path": "new/a.md", "size": 5, "mtime": 50}, {"native": "n2", "size": 7, "mtime": 61}, {"native": "n3", "path": "c.md", "size": 1, "mtime": 9}, {"native": "n4", "path": "mine", "size": 3, "mtime": 3, "own": True})
    assert run() == [("n1", "moved", "new/a.md", "a.md", 5, 50), ("n2", "changed", "b.md", "b.md", 7, 61)]
    # removed and added again before the removal is due: a move; a removal alone is due with the next batch
    page("p3", {"native": "n2", "removed": True}, {"native": "n3", "removed": True}, {"native": "n4", "path": "mine", "size": 3, "mtime": 3})
    page("p4", {"native": "n3", "path": "d.md", "size": 1, "mtime": 9})
    assert ("n3", "moved", "d.md", "c.md", 1, 9) in (first := run())
    page("p5", {"native": "n5", "path": "e", "size": 1, "mtime": 1})
    assert sorted(first + run()) == [("n2", "removed", "b.md", "b.md", 7, 61), ("n3", "moved", "d.md", "c.md", 1, 9), ("n5", "created", "e", None, 1, 1)]
    # the feed has lost its place: a listing takes its place, and only what differs from what is known counts
    listing = spark.createDataFrame([("n1", "new/a.md", 5, 50), ("n5", "e", 2, 2), ("n6", "f", 1, 1)], known.schema)
    now = spark.createDataFrame([("n1", "new/a.md", 5, 50), ("n3", "d.md", 1, 9), ("n5", "e", 1, 1)], known.schema)
    page("p6", *(r.asDict() for r in baseline_rows(listing, now).collect()))
    found = run()
    page("p7", {"native": "n7", "path": "g", "size": 1, "mtime": 1})
    assert sorted(found + run()) == [("n3", "removed", "d.md", "d.md", 1, 9), ("n5", "changed", "e", "e", 2, 2), ("n6", "created", "f", None, 1, 1), ("n7", "created", "g", None, 1, 1)]
