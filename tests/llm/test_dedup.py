import numpy as np
import pyarrow as pa
import pytest
from plain import components, documents, lower, ordered, shingles, texts, without_repeats

from tidemark.llm import jaccard, substrings, text
from tidemark.llm.decontaminate import drop_contained, find_contained


def test_jaccard_join(spark):
    out, links = jaccard.jaccard_join(documents(spark))
    assert ordered(out.collect()) == ordered(components(texts()))
    assert all(r["a"] < r["b"] for r in links.collect())


@pytest.mark.parametrize(("small", "paired", "flush", "buckets"), [(1, 3, 500, 3), (2, 2, 1 << 20, 40)])
def test_jaccard_join_with_many_documents_a_token(spark, monkeypatch, small, paired, flush, buckets):
    """The ways for common tokens: stars and salted pairs across components; small and large flushes."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    monkeypatch.setattr(jaccard, "FLUSH", flush)
    assert ordered(jaccard.jaccard_groups(documents(spark), buckets=buckets).collect()) == ordered(components(texts()))


@pytest.mark.parametrize(("small", "paired"), [(8, 500), (2, 3)])
def test_links_are_the_whole_join(spark, monkeypatch, small, paired):
    """A family of near copies that share their prefix tokens: all its pairs are links."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "PAIRED", paired)
    body = " ".join(f"w{i}" for i in range(60))
    family = [f"{body} end{i} of{i} it{i}" for i in range(20)] + [" ".join(f"w{i}" for i in range(9, 60 + j)) for j in range(6)]
    rows = [(i, t, "en") for i, t in enumerate(family)] + [(100, family[3], "en"), (101, "some other text that is like none of these", "en"), (102, "", "en")]
    sets = {i: set(shingles(t)) for i, t, _ in rows if t and i != 100}
    wanted = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert len(wanted) > 190
    _, links = jaccard.jaccard_join(documents(spark, rows))
    assert sorted((r["a"], r["b"]) for r in links.collect()) == sorted(wanted)
    counts = {r["doc_id"]: r["n_links"] for r in jaccard.link_counts(documents(spark, rows)).collect()}
    of = {i: sum(i in pair for pair in wanted) for i in sets}
    assert counts == of | {100: of[3]}


def test_jaccard_of_nothing(spark):
    assert jaccard.jaccard_join(documents(spark, []))[0].count() == 0


@pytest.mark.parametrize(("run", "chunk"), [(50, 100), (1_000_000, 1_000_000)])
def test_remove_repeats(spark, monkeypatch, run, chunk):
    monkeypatch.setattr(substrings, "RUN", run)
    monkeypatch.setattr(text, "CHUNK", chunk)
    assert ordered(substrings.remove_repeats(documents(spark)).collect()) == ordered(without_repeats(texts()))


def mirrored(n=1024):
    """Two words that differ everywhere, for which sums of letters times powers are equal modulo 2 ** 64 whatever the base."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_words_that_a_polynomial_confuses(spark):
    words = [f"w{i}" for i in range(34)]
    rows = [(i, " ".join([long, *words]), "en") for i, long in enumerate(mirrored())]
    assert [r["n_removed"] for r in substrings.remove_repeats(documents(spark, rows)).collect()] == [0, 0]
    rows = [(i, long, "en") for i, long in enumerate(mirrored())] + [(7, " ".join(mirrored()), "en"), (8, " ".join(mirrored()[::-1]), "en")]
    assert ordered(jaccard.jaccard_groups(documents(spark, rows)).collect()) == [(i, 1, i) for i in (0, 1, 7, 8)]


@pytest.mark.parametrize("partitions", ["1", "8", "64"])
def test_sets_whose_tokens_share_many_bits(spark, partitions):
    """Two runs of five words whose hashes once agreed in all bits that were kept; results depend on no number of partitions."""
    rows = [(1, "w28443 w676 w56957 w59597 w51642", "en"), (2, "w18197 w7336 w54111 w13751 w56008", "en"), *[(i, t, x) for i, t, x in texts() if i is not None and i < 300]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert ordered(jaccard.jaccard_groups(documents(spark, rows).repartition(3)).collect()) == ordered(components(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tokens_travel_whole():
    token = np.array([0, 1, (1 << 64) - 1, (1 << 40) + 5, 5], np.uint64)
    owner = np.array([0, 65535, 7, 1, 2], np.uint16)
    cells = jaccard.cut(jaccard.pack(token, owner), np.array([0, 2, 2, 5]))
    back, own, sizes = jaccard.unpack(pa.chunked_array([cells]))
    assert np.array_equal(back, token) and np.array_equal(own, owner) and sizes.tolist() == [2, 0, 3]


@pytest.mark.parametrize("chunk", [1, 2, 7, 1000])
def test_words_in_chunks(monkeypatch, chunk):
    data = ["", "one", "two words", " x  yy\tzzz ", "ends", "starts", "é" * 9, " "]
    raw = [t.encode() for t in data]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    whole = text.Words(lower=True)(np.frombuffer(b"".join(raw), np.uint8), offsets)
    monkeypatch.setattr(text, "CHUNK", chunk)
    parts = text.Words(lower=True)(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert all(np.array_equal(x, y) for x, y in zip(whole, parts, strict=True)) and len(whole[0]) == 9


def test_remove_repeats_of_nothing(spark):
    assert substrings.remove_repeats(documents(spark, [])).count() == 0


def test_first_must_fit(spark):
    with pytest.raises(ValueError, match="first"):
        substrings.remove_repeats(documents(spark), first=13)


def items(spark):
    rows = texts()
    passage = rows[14][1].split("\n")[1].split("\t")[0]
    return [(1, passage), (2, passage.upper()), (3, " ".join(passage.split()[:30]) + " and nothing of the rest of it"), (4, "one two"), (5, None), (6, ""), (7, "never seen words in any text at all")]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_find_contained(spark, limit):
    rows, wanted = items(spark), []
    table = spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, runs string")
    for i, t, _ in {r[:2]: r for r in texts()}.values():
        for j, b in rows:
            own, held = shingles(b), shingles(t)
            if own and 1000 * len(own & held) >= 750 * len(own):
                wanted.append((i, j, len(own), len(own & held)))
    found = find_contained(documents(spark), table, broadcast_rows=limit).select("doc_id", "item_id", "n_item", "n_common")
    assert ordered(found.collect()) == ordered(wanted) and wanted
    left = drop_contained(documents(spark), table)
    assert left.columns == documents(spark).columns
    gone = {w[0] for w in wanted}
    assert ordered((r["doc_id"],) for r in left.select("doc_id").collect()) == ordered((i,) for i, t, _ in texts() if i not in gone)


def test_contained_in_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert find_contained(documents(spark), none).count() == 0
    assert find_contained(documents(spark, []), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0
    assert lower("ÀB") == "Àb"
