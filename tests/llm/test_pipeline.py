"""Every stage and the whole pipeline against plain versions."""

import re

from plain import components, shingles
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidemark.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(tmp_path, spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ti", "an", "le", "ou"]) for _ in range(rng.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    item = text(30)
    rows, labels = [], []
    for i in range(240):
        t = text(rng.randint(40, 120))
        if i % 4 == 0:
            t, good = " ".join(w + "###" for w in t.split()), 0
        else:
            good = 1
            if i % 10 == 1 and (i - 1) % 4:
                t = rows[-1][1] + " " + word()
            if i % 30 == 7:
                t += "\n" + item + "\n" + text(20)
            if i % 20 == 3:
                t += " password=b7db7aa4a5fcc78305 " + text(3)
        rows.append((i, t, "en", "s", len(t)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, good, 0))
    write = lambda name, data, schema: spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    write("documents", rows, SCHEMA)
    write("labels", labels, "doc_id long, quality int, toxic int")
    write("benchmark", [(1, item)], "item_id long, text string")
    return str(tmp_path), item


def test_stages(spark, tmp_path):
    sf, item = corpus(tmp_path, spark)
    docs = table(spark, sf, "documents")
    collected = lambda df: {r["doc_id"]: r for r in df.collect()}
    good = pipeline.good_quality(spark, docs, sf)
    assert good.columns == docs.columns
    kept = set(collected(good))
    assert not any(i % 4 == 0 for i in kept) and len(kept) >= 175
    clear = docs.filter(F.col("doc_id") % 4 != 0)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in clear.collect()]
    wanted = {i for i, _, c in components(rows) if i == c}
    one = pipeline.one_of_each_group(spark, clear, sf)
    assert set(collected(one)) == wanted and len(wanted) < len(rows) and one.columns == docs.columns
    clean = pipeline.without_benchmark(spark, clear, sf)
    own = shingles(item)
    assert set(collected(clean)) == {i for i, t, _ in rows if len(own & shingles(t)) < 0.75 * len(own)} and clean.columns == docs.columns
    safe = collected(pipeline.without_secrets(spark, clear, sf))
    assert set(safe) == {r[0] for r in rows}
    for i, t, _ in rows:
        assert safe[i]["text"] == re.sub("password=[0-9a-f]+", "[SECRET]", t) and safe[i]["n_chars"] == len(safe[i]["text"])
    assert all(r["exact"] for r in pipeline.as_pieces(spark, clear, sf).collect())


def test_run(spark, tmp_path):
    sf, item = corpus(tmp_path, spark)
    out = pipeline.run(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    own = shingles(item)
    ids = {r["doc_id"] for r in out}
    kept = sorted(ids)
    rows = [(i, texts[i], None) for i in kept]
    assert all(c == i for i, _, c in components(rows)) and all(len(own & shingles(t)) < 0.75 * len(own) for _, t, _ in rows)
    assert len(out) == len(ids) > 100 and all(r["exact"] and r["n_tokens"] > 0 for r in out)
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "SentencePiece encoding and decoding"]


def test_empty_stages(spark, tmp_path):
    sf, _ = corpus(tmp_path, spark)
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, sf).count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words", "en", None, 10), (2, "", "en", "s", 0)], SCHEMA)
    for _, stage in pipeline.STAGES[1:]:
        assert stage(spark, odd, sf).count() == 4
    scored = pipeline.good_quality(spark, odd, sf)
    assert scored.columns == odd.columns and scored.count() in (0, 1, 3, 4)  # texts without tokens go together
