import os
import random
import re

import numpy as np
import pytest
from plain import documents, ordered, texts
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, nearest, pieces, quality, substrings


def labelled():
    rng = random.Random(2)
    parts = {"en": ["th", "er", "ing", "and"], "de": ["sch", "ung", "ein", "ü"], "fr": ["eau", "tion", "é", "oi"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    return [(i, " ".join(word(lang) for _ in range(rng.randint(8, 60))), lang) for i, lang in enumerate(list(parts) * 60)]


def test_language(spark):
    rows = labelled()
    model = language.train(documents(spark, rows[:120]))
    found = {r["doc_id"]: r for r in language.identify(documents(spark, rows[120:]), model).collect()}
    assert np.mean([found[i]["lang_pred"] == lang for i, _, lang in rows[120:]]) > 0.95
    odd = {r["doc_id"]: r for r in language.identify(documents(spark), model).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 and odd[i]["rejected"] for i in (320, 321, 322, 325))
    assert all(0 <= r["score"] <= 1 for r in odd.values()) and odd[330]["lang_pred"] == "en"
    assert language.identify(documents(spark), model).count() == len(texts())


def test_language_without_rows(spark):
    model = language.train(documents(spark, []))
    assert {r["lang_pred"] for r in language.identify(documents(spark), model).collect()} == {"und"}
    assert language.identify(documents(spark, []), model).count() == 0


def test_quality(spark):
    rows = labelled()
    bad = lambda i, t: t if i % 3 else (" ".join(w + "###" for w in t.split()) if i % 2 else (t.split()[0] + " ") * 30)
    docs = documents(spark, [(i, bad(i, t), lang) for i, t, lang in rows])
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _, _ in rows] + [(9999, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(docs, labels.filter("doc_id < 120"))
    out = quality.score_quality(docs, model, name="p").filter("doc_id >= 120")
    assert out.columns == [*docs.columns, "p"]
    assert np.mean([(r["p"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in out.collect()]) > 0.9
    odd = quality.score_quality(documents(spark), model)
    assert odd.count() == len(texts()) and odd.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(documents(spark, []), quality.train(documents(spark, []), labels.limit(0))).count() == 0


def brute(rows, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ok = list({i: (i, v) for i, v in ok}.values())
    out = []
    for i, q in ok:
        if i % 3 == 0:
            others = [(-float((q * v).sum() / (np.sqrt((q * q).sum()) * np.sqrt((v * v).sum()))), j) for j, v in ok if j != i and len(v) == len(q)]
            out += [(i, n + 1, j) for n, (_, j) in enumerate(sorted(others)[:k])]
    return out


def test_nearest(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(150)] + [(200 + i, [1.0] * 8) for i in range(12)] + [(300, [2.0] * 8), (301, [0.0] * 8), (302, None), (303, [float("nan")] * 8), (304, [None] * 8), (305, []), (306, [1.0, 2.0]), (309, [2.0, 1.0]), (None, [1.0] * 8)]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows + rows[:1]], "vec_id long, embedding array<float>, dim string")
    out = nearest.nearest(table, F.col("vec_id") % 3 == 0, shard_rows=60, block_rows=20)
    assert ordered((r["query_id"], r["rank"], r["vec_id"]) for r in out.collect()) == ordered(brute(rows, 5))
    assert nearest.nearest(table.limit(0), F.col("vec_id") % 3 == 0).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(6)
    v = nearest.unit(rng.normal(size=(1500, 24)))
    g = nearest.Graph(v)
    hits = sum(len(set(g.search(v[i], 6)) & set(np.argsort(-(v @ v[i]))[:6].tolist())) for i in range(0, 1500, 15))
    assert hits / 600 >= 0.95


@pytest.fixture(scope="module")
def tiny():
    words = ["▁", "▁th", "th", "e", "▁the", "an", "t", "h", "é", "▁▁", "n", "a"]
    texts_ = {i + 3: w for i, w in enumerate(words)}
    n = 3 + len(words) + 256
    scores = np.zeros(n)
    scores[3 : 3 + len(words)] = -np.linspace(1, 6, len(words))
    return pieces.pack_pieces(texts_, scores, np.arange(3 + len(words), n, dtype=np.int32)), {w.replace("▁", " ").encode(): scores[i] for i, w in texts_.items()}


def best_score(text, known, fallback):
    b = (" " + text).encode()
    best = [0.0] + [-1e18] * len(b)
    for e in range(1, len(b) + 1):
        for s in range(max(0, e - 8), e):
            gain = known.get(b[s:e], fallback if e - s == 1 else None)
            if gain is not None:
                best[e] = max(best[e], best[s] + gain)
    return best[-1]


def test_pieces(spark, tiny):
    model, known = tiny
    out = pieces.encode_pieces(documents(spark), model, keep=["doc_id", "text"]).collect()
    assert len(out) == len(texts())
    for r in out:
        assert r["exact"] and r["n_tokens"] == len(r["ids"])
        if r["text"]:
            assert abs(r["score"] - best_score(r["text"], known, model["byte_score"])) < 1e-6 * max(1, abs(r["score"]))
        else:
            assert r["ids"] == [] and r["score"] == 0
    back = pieces.decode_pieces(pieces.encode_pieces(documents(spark), model), model).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in back)
    assert pieces.encode_pieces(documents(spark, []), model).count() == 0


def test_pieces_of_words_that_share_a_hash(spark, tiny, monkeypatch):
    """Words are told apart by their bytes, whatever their hashes."""
    from test_dedup import mirrored

    model, _ = tiny
    rows = [(i, f"x {long} y {long}z", "en") for i, long in enumerate(mirrored())]
    back = lambda: ordered(pieces.decode_pieces(pieces.encode_pieces(documents(spark, rows), model, keep=["doc_id", "text"]), model).select("text", "decoded", "exact").collect())
    assert back() == ordered((t, t, True) for _, t, _ in rows)
    data = np.frombuffer(b"one two one three two", np.uint8)
    starts, ends = np.array([0, 4, 8, 12, 18]), np.array([3, 7, 11, 17, 21])
    for same in (False, True):
        if same:
            monkeypatch.setattr(pieces, "hash_blocks", lambda block, number, at, length: np.zeros(len(at) - 1, np.uint64))
        first, which = pieces.distinct_words(data, starts, ends)
        found = [data[starts[first[w]] : ends[first[w]]].tobytes() for w in which]
        assert found == [b"one", b"two", b"one", b"three", b"two"]


def test_pieces_of_a_public_model(spark):
    if not os.path.exists(pieces.MODEL):
        pytest.skip("no vocabulary file")
    out = pieces.decode_pieces(pieces.encode_pieces(documents(spark)))
    assert all(r["decoded"] == (r["text"] or "") for r in out.collect())


@pytest.mark.parametrize("text", ["thethe an " * 400, "the" * 3000, "th" * 2000 + " é" * 900, "t" * 5000, "漢字" * 1500, " " * 3000 + "the"])
def test_pieces_of_a_long_text_in_stretches(monkeypatch, tiny, text):
    model, known = tiny
    encoder = pieces.Encoder(model)
    data = np.frombuffer(text.encode(), np.uint8)
    whole, _, score = encoder.encode(data, np.array([0, len(data)]))
    monkeypatch.setattr(pieces, "CHUNK", 256)
    ids, total, exact = encoder.encode_long(data)
    assert exact and abs(total - score[0]) < 1e-6 * abs(score[0]) and abs(total - best_score(text, known, model["byte_score"])) < 1e-6 * abs(total)
    assert encoder.decode(ids, np.array([0, len(ids)]))[0].tobytes() == data.tobytes() == encoder.decode(whole, np.array([0, len(whole)]))[0].tobytes()


def test_long_texts(spark):
    """20 MB in one text, with few spaces or none, through every operator that reads texts in Python."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ti"]) for _ in range(3))
    words = [word() for _ in range(50_000)]
    long = " ".join(words[rng.randrange(len(words))] for _ in range(2_900_000))
    rows = [(1, long, "en"), (2, "é" * 1_500_000, "fr"), (3, "short", "en")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score_quality(docs, model).filter("score between 0 and 1").count() == 3
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, language.train(documents(spark, labelled()))).collect()}
    assert found[1] == "en" and len(found) == 3
    if os.path.exists(pieces.MODEL):
        out = pieces.encode_pieces(docs, keep=["doc_id"]).select("doc_id", "n_tokens", "exact").collect()
        assert all(r["exact"] for r in out) and len(out) == 3


def test_models_do_not_depend_on_the_layout(spark):
    docs = documents(spark, labelled())
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(180)], "doc_id long, quality int")
    one, two = (language.train(d) for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(3)))
    assert np.allclose(one.table, two.table) and one.temperature == two.temperature
    x, y = (quality.train(d, labels) for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(3)))
    assert np.allclose(x.w1, y.w1) and x.temperature == y.temperature


def plain_scores(model, text):
    """The probability of one text, token by token."""
    tokens = re.findall(r"[a-z\x80-\U0010ffff]+|[A-Z]+|[0-9]+|[^\sa-zA-Z0-9\x80-\U0010ffff]+", text)
    t = quality.Tokens()
    rows = [t(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())]))[0][0] for x in tokens]
    v = model.vectors[rows].astype(float)
    x = np.concatenate([v.mean(axis=0), np.sqrt(np.maximum((v**2).mean(axis=0) - v.mean(axis=0) ** 2, 0)), np.abs(np.diff(v, axis=0)).sum(axis=0) / len(v)]) if rows else np.zeros(3 * quality.SIZE)
    z = np.clip((x - model.mean) / model.scale, -8, 8)
    return 1 / (1 + np.exp(-(np.tanh(z @ model.w1 + model.b1) @ model.w2 + model.b2) / model.temperature))


def test_quality_is_the_plain_one(spark):
    docs = documents(spark)
    model = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(100, 240)], "doc_id long, quality int"))
    for r in quality.score_quality(docs, model).select("text", "score").collect():
        assert abs(r["score"] - plain_scores(model, r["text"] or "")) < 1e-3


def plain_language(model, text):
    """Label and score of one text, from its runs of 3 and 4 bytes within words."""
    fold = bytes(b + 32 if 65 <= b < 91 else 32 if b < 65 or 91 <= b < 97 or 123 <= b < 128 else b for b in text.encode())
    total, n = np.zeros(len(model.labels)), 0
    for word in fold.split(b" "):
        if word:
            for g, at in language.subwords(np.frombuffer(word, np.uint8), np.array([0, len(word)])):
                total += model.table[g].sum(axis=0)
                n += len(g)
    z = (total / max(n, 1) + model.bias) / model.temperature
    p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    return model.labels[int(p.argmax())], p.max()


def test_language_is_the_plain_one(spark):
    model = language.train(documents(spark, labelled()))
    for r in language.identify(documents(spark, labelled()[:40]), model).join(documents(spark, labelled()[:40]).select("doc_id", "text"), "doc_id").collect():
        label, score = plain_language(model, r["text"])
        assert r["lang_pred"] == label and abs(r["score"] - score) < 1e-4


def test_session_settings_stay(spark, tiny):
    before = {k: spark.conf.get(k) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.shuffle.partitions")}
    docs = documents(spark, labelled()[:20])
    jaccard.jaccard_groups(docs)
    substrings.remove_repeats(docs)
    pieces.encode_pieces(docs, tiny[0]).count()
    nearest.nearest(spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "vec_id long, embedding array<double>"), F.col("vec_id") == 1).count()
    assert before == {k: spark.conf.get(k) for k in before}


def test_trie():
    rng = random.Random(8)
    words = {bytes(rng.choice(b"abcd\xff") for _ in range(rng.randint(1, 6))): i for i in range(300)}
    base, check, value = pieces.build_trie(words)
    for probe in [*words, b"zz", b"abcdabcd"]:
        s = 0
        for b in probe:
            t = base[s] + b
            s = t if check[t] == s else None
            if s is None:
                break
        assert (int(value[s]) if s is not None else -1) == words.get(probe, -1)
