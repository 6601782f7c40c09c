"""Tries, repairs and archives against plain versions, odd rows included."""

import base64
import functools
import gzip
import hashlib
import io
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import warc
from tidemark.llm.common import Scratch
from tidemark.llm.queries import _crc
from tidemark.llm.repair import damage, repair_conversations, solve
from tidemark.llm.trie import conversation_paths, prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TALK = "conv_id long, turn long, role string, text string, path string, key string, block string, copy string, tie string"


def talks(spark, rows):
    """Conversations with columns whose names the operators also use inside."""
    return spark.createDataFrame([(*r, *["x"] * 5) for r in rows], TALK)


def conversations():
    rng = random.Random(3)
    rows = []
    for c in [*range(0, 6), *range(18, 47), -1, -3, -20, -23, 1000]:
        if c == 20:
            continue  # a block without its own conversation
        for t in range(rng.randint(1, 6)):
            rows.append((c, t * rng.choice([1, 1, 2]), rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Hi there.", "What now?", "so and so", "", None, " \n", "a b c!", "end. ", "Hi\n\n"])))
    rows += [(50, t, "user" if t % 2 == 0 else "assistant", "same words here.") for t in range(40)]  # a long one
    rows += [(c, t, r, x) for c in range(60, 75) for t, (r, x) in enumerate([("user", "copy me."), ("assistant", "done.")])]
    rows += [(80, None, "user", "no turn."), (80, 1, "assistant", "fine."), (80, 1, "assistant", "fine."), (None, 1, "user", "lost."), (None, None, None, None), (81, 2, "user", "x " * 30_000)]
    return rows


def crc(text):
    return zlib.crc32(text.encode())


def plain_trie(rows):
    turns = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            turns.setdefault(c, []).append(((t is not None, t or 0), hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest(), r, x))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h, base = crc(str(c)) % 4, c - int(c - 20 * int(c / 20))
        rebuilt[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = {}
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    out = []
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = lambda n: sum(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        saved = sum((len(members[n]) - 1) * (len(WORDS.findall(n[-1][1])) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(held) if rebuilt[c] == node)
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), kids(node), sum(not kids(n) for n in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie(df):
    return prefix_trie(conversation_paths(df, F.col("conv_id") - F.col("conv_id") % 20, _crc("conv_id") % 4))


def test_trie(spark):
    rows = conversations()
    out = trie(talks(spark, rows))
    assert sorted((tuple(r) for r in out.select(*COLUMNS).collect()), key=repr) == plain_trie(rows)
    # intervals: places count from 0, a subtree has its nodes
    spans = sorted((r["preorder"], r["subtree_end"]) for r in out.collect())
    assert [a for a, _ in spans] == list(range(len(spans))) and spans[0] == (0, len(spans) - 1)
    assert all(f <= e or e < g for (_, e), (g, f) in zip(spans, spans[1:], strict=False))


def test_trie_of_nothing(spark):
    assert trie(talks(spark, [])).collect() == []
    assert trie(talks(spark, [(None, 1, "user", "x")])).collect() == []


@pytest.mark.parametrize("block", [1, 65_536])
def test_ends_across_blocks_and_partitions(spark, block, monkeypatch):
    from tidemark.llm import trie as module

    monkeypatch.setattr(module, "BLOCK", block)
    ends = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit(b"hot")).otherwise(F.col("id").cast("string").cast("binary")).alias("key"), F.col("id").alias("conv_id"))
    out = {bytes(r["key"]): r["digest"] for r in module.end_digests(Scratch(spark, "ends"), ends).collect()}
    assert len(out) == 2001 and out[b"hot"] == hashlib.sha256(",".join(str(i) for i in range(0, 3000, 3)).encode()).hexdigest()


NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_solve(rows):
    """rows: (initial, fault). The cheapest audit by recursion over all edits, audits compared as they are."""

    @functools.cache
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in (0, 3) else []
        if i < len(rows):
            role, fault = rows[i]
            after = lambda cost, letter, rest: (cost + rest[0], letter + rest[1])
            found.append(after(3, "D", best(i + 1, state, 0)))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if (state, role) in NEXT:
                    found.append(after(extra, "K", best(i + 1, NEXT[state, role], 0)))
                found += [after(2 + extra, "R", best(i + 1, NEXT[state, r], 0)) for r in "ua" if (state, r) in NEXT]
        if inserted < 4:
            found += [(2 + rest[0], "I" + rest[1]) for r in "ua" if (state, r) in NEXT for rest in [best(i, NEXT[state, r], inserted + 1)]]
        return min(found) if found else (10**9, "")

    return best(0, 0, 0)


def plain_repair(rows):
    told = {}
    for c, t, r, x in rows:
        held = told.setdefault(c, [])
        r, x = " " if r is None else r, " " if x is None else x
        fate = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        tie = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).digest()
        x2 = "" if fate == 1 else re.sub("[.!?]", "", x) if fate == 2 else x
        if fate:
            held += [((t is not None, t or 0), tie, t, "user" if fate == 4 else r, x2)] * (2 if fate == 3 else 1)
    out = []
    for c, held in told.items():
        held = sorted(held, key=lambda h: h[:2])
        seen, faults = set(), []
        for _, _, _, r, x in held:
            said = x.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else None)
            seen.add((r, x))
        turns = {t for _, _, t, _, _ in held if t is not None}
        first = [r[:1] for _, _, _, r, _ in held]
        cost, audit = plain_solve(tuple(zip(first, faults, strict=True)))
        state, lines, at = 0, [], 0
        for letter in audit:
            made = "assistant" if state == 2 else "user"
            role, text = (made, "") if letter == "I" else (held[at][3] if letter == "K" else made, held[at][4])
            at += letter != "I"
            if letter != "D":
                lines.append(f"{role}:{text}")
                state = NEXT[state, role[0]]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repair(spark):
    rows = conversations()
    out = repair_conversations(damage(talks(spark, rows))).collect()
    assert sorted((tuple(r) for r in out), key=repr) == plain_repair(rows)


def test_repair_of_nothing_and_of_dropped_rows(spark):
    assert repair_conversations(damage(talks(spark, []))).collect() == []
    gone = next(c for c in range(1000) if crc(f"{c}:0") % 20 == 0)
    assert [tuple(r) for r in repair_conversations(damage(talks(spark, [(gone, 0, "user", "x")]))).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_signatures():
    rng = random.Random(0)
    faults = {"-": "blank"}
    for n in range(7):
        for _ in range(80):
            s = "".join(rng.choice("suaxSUAX-") for _ in range(n))
            assert solve(s) == plain_solve(tuple((c.lower(), faults.get(c) or ("truncated" if c.isupper() else None)) for c in s)), s
    assert solve("ua" * 20_000 + "u") == (2, "K" * 40_001 + "I")


PAGES = "page_id long, url string, html string, record string, chunk string, digest string, last string, refers string"


def page_rows():
    big = "".join(chr(33 + i % 90) for i in range(150_000))
    texts = ["", None, "<p>é😀</p>", big, big, "WARC/1.1\r\n\r\nnot a record\r\n\r\n", "a\r\n\r\n", "<p>é😀</p>", None, "one"]
    rows = [(i * 3, f"http://x/{i}\r\nInjected: yes" if i % 4 == 0 else None if i % 4 == 1 else "http://é/ ü", t) for i, t in enumerate(texts)]
    return [*rows, (100, "http://y", "copy"), (99, "http://z", "copy"), (100, "http://y", "copy"), (None, None, "copy"), (None, None, "alone"), (None, None, "alone")]


def plain_warc(rows, least=0):
    seen = {}
    for n, (i, _, t) in enumerate(rows):
        seen.setdefault((t or "").encode(), []).append((i is None, i, n))
    out = []
    for n, (i, _, t) in enumerate(rows):
        data = (t or "").encode()
        none, first, at = min(seen[data], key=lambda x: (x[0], x[1] or 0, x[2]))
        again = at != n and len(data) >= least
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "size", "roll"), [(0, 1000, 2000), (4, 65_536, 64_000_000)])
def test_warc(spark, least, size, roll):
    pages = spark.createDataFrame([(*r, *["x"] * 5) for r in page_rows()], PAGES).coalesce(1)
    out = warc.through_warc(pages, least=least, size=size, roll=roll).collect()
    assert sorted((tuple(r) for r in out), key=repr) == plain_warc(page_rows(), least)


def test_archives_hold_what_was_written(spark):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, *["x"] * 5) for r in rows], PAGES).coalesce(1)
    scratch = Scratch(spark, "warc")
    chunks = scratch.save(warc.chunk_payloads(pages, "page_id", "url", "html", 1000), "chunks")
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] == 1000
    files = warc.write_warc(scratch, chunks, warc.settle_records(scratch, chunks), f"{scratch.root}/archives", roll=1)
    assert files.count() == len(rows) and files.agg(F.sum("records")).first()[0] == len(rows)
    found = warc.read_warc(files, 700)
    got = {}
    for r in found.filter("record_type = 'response'").orderBy("record_id", "chunk").collect():
        body, key = got.setdefault(r["record_id"], [b"", r["id"]])
        assert r["chunk"] * 700 == len(body)
        got[r["record_id"]][0] = body = body + r["data"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
    assert sorted(b for b, _ in got.values()) == sorted({(t or "").encode() for _, _, t in rows})
    assert {r["uri"] for r in found.collect()} == {"urn:none", "http://é/%20ü", "http://y", "http://z", *(f"http://x/{i}%0D%0AInjected:%20yes" for i in (0, 4, 8))}


def test_archives_that_are_damaged():
    row = {"id": "7", "record": 1, "uri": "http://x", "so_far": 5, "digest": base64.b32encode(hashlib.sha1(b"hello").digest()).decode(), "refers": None}
    good = warc.header(row, "2000-01-01T00:00:00Z") + b"hello\r\n\r\n"
    read = lambda data: list(warc.read_records(gzip.GzipFile(fileobj=io.BytesIO(gzip.compress(data)))))
    assert [(r[1], r[6], r[7]) for r in read(good + good)] == [("7", b"hello", 5)] * 2
    for bad in (good.replace(b"hello\r", b"hallo\r"), good[:-6], good[:60], b"x" + good):
        with pytest.raises(warc.BadRecord):
            read(bad)
    assert [warc.record_key(warc.record_name(k, 3)) for k in ("1", "", None, "a:b/%", "é ")] == ["1", "", None, "a:b/%", "é "]


def test_warc_of_nothing(spark):
    assert warc.through_warc(spark.createDataFrame([], PAGES)).collect() == []
