"""Plain versions to hold the operators against, over a small table with every odd case."""

import hashlib
import random
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns whose names the operators also use inside.
EXTRA = "score double, label string, _h string, _n string, _text string, id string, rid string, n string, w string, ids string, words string, matches string, secret_spans string, rep string, a string, b string"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    wide = [(i, t, lang, "src", len(t) if t is not None else None, 9.0, *["x"] * 15) for i, t, lang in rows]
    return spark.createDataFrame(wide, SCHEMA)


def texts():
    """ids, texts and languages: copies, near copies, chains, repeats within a text, empty, null and long ones."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["th", "er", "on", "ti", "an", "le"]) for _ in range(rng.randint(1, 5)))
    text = lambda n: " ".join(word() for _ in range(n))
    out = []
    base = text(120).split()
    for i in range(14):  # one family: copies with a few words changed, each from the one before
        out.append((100 + i, " ".join(base), "en"))
        base = list(base)
        base[rng.randrange(len(base))] = word()
    passage = text(60)
    for i in range(12):
        out.append((200 + i, f"{text(rng.randint(30, 90))}\n{passage}\t{text(20)}", "de" if i % 2 else "en"))
    same = text(50)
    out += [(300, same, "en"), (301, same.upper(), "en"), (301, same.upper(), "en"), (302, same.replace(" ", "\n\n"), None)]
    line = text(40)
    out += [(310, f"{line} x {line} y {line}", "en"), (311, "la " * 90, "fr"), (312, "la " * 90, "fr")]
    out += [(320, None, "en"), (321, "", "en"), (322, " \t\n", "de"), (323, "one two", "en"), (324, "One TWO", "en"), (325, "12 34 !!", None), (326, "é ñ 漢字 😀 ▁x", "fr")]
    out += [(None, None, None), (None, text(45), "en"), (330, text(9000), "en"), (331, "z" * 30_000, "en")]
    return out


def shingles(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = {}
    for i, t, _ in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and any(s and t and 100 * len(s & t) >= 75 * len(s | t) for s in sets[x] for t in sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return [(i, len(shingles(t)), root(i) if i is not None else None) for i, t, _ in rows]


def without_repeats(rows, span=35):
    words = [WORD.findall(t or "") for _, t, _ in rows]
    counts = Counter(tuple(w[i : i + span]) for w in words for i in range(len(w) - span + 1))
    out = []
    for (i, _, _), w in zip(rows, words, strict=True):
        gone = set()
        for j in range(len(w) - span + 1):
            if counts[tuple(w[j : j + span])] > 1:
                gone.update(range(j, j + span))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=repr)
