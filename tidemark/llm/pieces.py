"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

Pieces have log scores; a text's encoding is the sequence of pieces of largest total score. What no piece
covers falls back to byte pieces. The whitespace marker stands for a space, and a space is put before each
text. As no piece has a marker after another character, the best encoding of a text is that of its words,
each with the spaces before it; equal words of a batch are encoded once, all positions of all of them at a
time in numpy. Within a word, a place that no piece reaches across is an edge of every encoding, so words are cut
there first; a text of more than ``CHUNK`` bytes is worked on in stretches that end before a space or at such a
place. A marker character that a text itself holds is encoded by bytes, so decoding is exact.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh
from .text import blocks, hash_blocks, pieces

MODEL = os.environ.get("TIDEMARK_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARKER = "▁"
CHUNK = 500_000


def load_pieces(path: str = MODEL) -> dict:
    """Pieces, log scores and byte pieces of a SentencePiece model, with their trie, as plain arrays.

    A unigram model's scores are log probabilities. Other models give ranks, which count as Zipf's law has
    it: the probability falls with 1 / (rank + 10).
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    scores = np.array([sp.get_score(i) for i in range(n)])
    normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    texts = {i: sp.id_to_piece(i) for i in normal}
    byte_ids = np.full(256, -1, np.int32)
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
    own = scores[normal]
    if len(own) > 2 and np.all(np.diff(own) == -1):
        weight = 1 / (np.arange(len(own)) + 10)
        scores[normal] = np.log(weight / weight.sum())
    return pack_pieces(texts, scores, byte_ids)


def pack_pieces(texts: dict[int, str], scores: np.ndarray, byte_ids: np.ndarray) -> dict:
    if any(MARKER in t.lstrip(MARKER) for t in texts.values()):
        raise ValueError("a piece has a marker after another character")
    if (byte_ids < 0).any():
        raise ValueError("a byte has no piece")
    raw = {i: t.replace(MARKER, " ").encode() for i, t in texts.items()}
    base, check, value = build_trie({b: i for i, b in raw.items()})
    n = len(scores)
    spelled = [raw.get(i, b"") for i in range(n)]
    for b, i in enumerate(byte_ids):
        spelled[i] = bytes([b])
    at = np.zeros(n + 1, np.int64)
    np.cumsum([len(x) for x in spelled], out=at[1:])
    least = min((scores[i] for i in texts), default=0.0) - 10
    return {"base": base, "check": check, "value": value, "scores": scores.astype(float), "byte_ids": byte_ids.astype(np.int32), "byte_score": float(least), "bytes": np.frombuffer(b"".join(spelled), np.uint8), "at": at, "longest": max(map(len, raw.values()), default=1)}


def build_trie(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double array: the child of state s by byte b is t = base[s] + b if check[t] == s; value[t] is a word's number or -1."""
    children: list[dict[int, int]] = [{}]
    number = [-1]
    for word, i in words.items():
        node = 0
        for b in word:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                number.append(-1)
            node = children[node][b]
        number[node] = i
    # nodes with most children first, into free room; what has one child fills the gaps
    used, start = bytearray(2 * len(children) + 1024), [0] * len(children)
    used[0] = 1
    hint: dict[int, int] = {}
    for node in sorted(range(len(children)), key=lambda i: -len(children[i])):
        kids = sorted(children[node])
        if not kids:
            break
        at = max(hint.get(len(kids), 1), 1)
        while True:
            at = used.find(0, at)
            if at < 0 or at + 512 > len(used):
                used.extend(bytes(len(used)))
                at = used.find(0, hint.get(len(kids), 1))
            if at >= kids[0] and not any(used[at - kids[0] + k] for k in kids):
                break
            at += 1
        start[node] = at - kids[0]
        hint[len(kids)] = at
        for k in kids:
            used[at - kids[0] + k] = 1
    base, check, value = ([x] * len(used) for x in (0, -1, -1))
    place = [0] * len(children)
    for node in range(len(children)):  # parents have smaller numbers
        s = place[node]
        value[s], base[s] = number[node], start[node]
        for k, child in children[node].items():
            place[child] = start[node] + k
            check[start[node] + k] = s
    pad = [0] * 256
    return np.array(base + pad, np.int64), np.array(check + [-1] * 256, np.int64), np.array(value + [-1] * 256, np.int32)


def matches(text: np.ndarray, stop: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and id of all pieces from all places: the trie is walked from every place at once, up to its ``stop``."""
    begin, length, piece = [], [], []
    place, state = np.arange(len(text)), np.zeros(len(text), np.int64)
    for depth in range(m["longest"]):
        live = place + depth < stop[place]
        place, state = place[live], state[live]
        t = m["base"][state] + text[place + depth]
        ok = m["check"][t] == state
        place, state = place[ok], t[ok]
        if not len(place):
            break
        word = m["value"][state] >= 0
        begin.append(place[word])
        length.append(np.full(int(word.sum()), depth + 1))
        piece.append(m["value"][state[word]])
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (begin, length, piece))


def edges_within(n: int, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each place of n whether no piece reaches across it."""
    across = np.zeros(n + 1, np.int64)
    long = length > 1
    np.add.at(across, begin[long] + 1, 1)
    np.add.at(across, begin[long] + length[long], -1)
    return np.cumsum(across)[:n] == 0


def viterbi(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, m: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece ids of the stretches of data end to end, their n + 1 offsets, and the scores. Ties go to the longer last piece."""
    total = int((ends - starts).sum())
    if not total:
        return np.zeros(0, np.int32), np.zeros(len(starts) + 1, np.int64), np.zeros(len(starts))
    # the stretches by themselves, end to end
    size = ends - starts
    given = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(size, out=given[1:])
    own = np.repeat(np.arange(len(starts)), size)
    text = data[np.arange(total) - given[own] + starts[own]].astype(np.int64)
    begin, length, piece = matches(text, given[own + 1], m)
    # shorter stretches: cut where no piece reaches across
    cut = edges_within(total, begin, length)
    cut[given[:-1][size > 0]] = True
    at = np.append(np.flatnonzero(cut), total)
    size, n = np.diff(at), len(at) - 1
    own = np.repeat(np.arange(n), size)
    fallback = np.repeat([True, False], [total, len(begin)])
    begin, length, piece = np.concatenate([np.arange(total), begin]), np.concatenate([np.ones(total, np.int64), length]), np.concatenate([m["byte_ids"][text], piece])
    gain = np.where(fallback, m["byte_score"], m["scores"][piece])
    close = begin + length
    u = own[begin]
    far = close - at[u]
    # by place in the stretch, then end, longer pieces first
    order = np.argsort((far * (total + 1) + close) * 4096 - length)
    begin, piece, gain, close, far = begin[order], piece[order], gain[order], close[order], far[order]
    # place p of stretch u is kept at p + u, so that each stretch has a place for its end
    best, back = np.zeros(total + n), np.zeros(total + n, np.int64)
    shift = own[begin]
    source, target = begin + shift, close + shift
    bounds = np.searchsorted(far, np.arange(1, int(size.max()) + 2))
    for j in range(len(bounds) - 1):
        a, b = bounds[j], bounds[j + 1]
        if a == b:
            continue
        score = best[source[a:b]] + gain[a:b]
        goal = target[a:b]
        new = np.ones(b - a, bool)
        new[1:] = goal[1:] != goal[:-1]
        first = np.flatnonzero(new)
        top = np.maximum.reduceat(score, first)
        group = np.cumsum(new) - 1
        hit = np.flatnonzero(score == top[group])
        lead = np.ones(len(hit), bool)
        lead[1:] = group[hit[1:]] != group[hit[:-1]]
        best[goal[first]] = top
        back[goal[first]] = a + hit[lead]
    tail = at[1:] + np.arange(n)
    score = best[tail]
    who, cur = np.flatnonzero(size > 0), tail[size > 0]
    units, ids = [], []
    while len(who):
        edge = back[cur]
        units.append(who)
        ids.append(piece[edge])
        cur = source[edge]
        go = cur > at[who] + who
        who, cur = who[go], cur[go]
    step = np.repeat(np.arange(len(units)), [len(x) for x in units])
    units, ids = np.concatenate(units), np.concatenate(ids)
    order = np.lexsort((-step, units))
    # back to the stretches given
    first = np.searchsorted(at, given)
    sums = np.concatenate([[0.0], np.cumsum(score)])
    return ids[order].astype(np.int32), np.searchsorted(units[order], np.arange(n + 1))[first], sums[first[1:]] - sums[first[:-1]]


def ragged(values: np.ndarray, at: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The picked rows of a ragged array, end to end, and their offsets."""
    size = at[pick + 1] - at[pick]
    out = np.zeros(len(pick) + 1, np.int64)
    np.cumsum(size, out=out[1:])
    index = np.arange(out[-1]) + np.repeat(at[pick] - out[:-1], size)
    return values[index], out


def distinct_words(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, and for every word which of them it is. Words that share a hash are compared byte by byte."""
    block, number, at = blocks(text, starts, ends)
    if not len(block):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    _, first, which = np.unique(hash_blocks(block, number, at, ends - starts), return_index=True, return_inverse=True)
    like, size = first[which], np.diff(at)
    apart = (size != size[like]) | (ends - starts != (ends - starts)[like])
    same = np.repeat(~apart, size)
    unlike = np.flatnonzero(same)[block[same] != block[(np.repeat(at[like], size) + number)[same]]]
    apart[np.searchsorted(at, unlike, "right") - 1] = True
    odd = np.flatnonzero(apart)
    which[odd] = len(first) + np.arange(len(odd))
    return np.concatenate([first, odd]), which


class Encoder:
    def __init__(self, model: dict) -> None:
        self.model = model

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, their offsets by text, and the score of each text; an empty text has none."""
        n = len(offsets) - 1
        full = np.diff(offsets) > 0
        lead = np.cumsum(full)
        text = np.full(len(data) + int(lead[-1] if n else 0), 32, np.uint8)
        text[np.arange(len(data)) + np.repeat(lead, np.diff(offsets))] = data
        edges = offsets + np.concatenate([[0], lead])
        return self._words(text, edges)

    def _words(self, text: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of texts between edges that have their first space already."""
        space = text == 32
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(text))[: len(starts)]
        first, which = distinct_words(text, starts, ends)
        ids, at, score = viterbi(text, starts[first], ends[first], self.model)
        words = np.searchsorted(starts, edges)
        out, by_word = ragged(ids, at, which)
        sums = np.concatenate([[0.0], np.cumsum(score[which])])
        return out, by_word[words], sums[words[1:]] - sums[words[:-1]]

    def _stretch(self, data: np.ndarray, at: int) -> int:
        """Where a stretch of about CHUNK bytes from ``at`` on may end: before a space that begins a word, else where no piece reaches across."""
        size = CHUNK
        while at + size < len(data):
            near = data[at : at + size]
            begins = np.flatnonzero((near[1:] == 32) & (near[:-1] != 32))
            if len(begins):
                return at + int(begins[-1]) + 1
            window = data[at : at + size + self.model["longest"]].astype(np.int64)
            begin, length, _ = matches(window, np.full(len(window), len(window)), self.model)
            places = np.flatnonzero(edges_within(len(window), begin, length)[1:size])
            if len(places):
                return at + int(places[-1]) + 1
            size *= 2
        return len(data)

    def encode_long(self, data: np.ndarray) -> tuple[np.ndarray, float, bool]:
        """ids, score and whether decoding gives back the text, of one text of any length."""
        ids, total, exact, at = [], 0.0, True, 0
        while at < len(data):
            to = self._stretch(data, at)
            part = data[at:to] if at else np.concatenate([[np.uint8(32)], data[:to]])
            own, _, score = self._words(part, np.array([0, len(part)]))
            back, _ = ragged(self.model["bytes"], self.model["at"], own)
            exact = exact and np.array_equal(back, part)
            ids.append(own)
            total, at = total + float(score[0]), to
        return np.concatenate(ids), total, exact

    def decode(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts whose ids end to end are given: the pieces without the first space."""
        data, by_id = ragged(self.model["bytes"], self.model["at"], ids)
        edges = by_id[at]
        drop = np.zeros(len(data), bool)
        drop[edges[:-1][np.diff(at) > 0]] = True
        gone = np.concatenate([[0], np.cumsum(drop)])
        return data[~drop], edges - gone[edges]


#: What encode_pieces adds.
ENCODED = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()),
    T.StructField("score", T.DoubleType()), T.StructField("exact", T.BooleanType())])


def _encode(shared, keep: int):
    def run(batches):
        encoder = Encoder(shared.value)
        byte_piece = np.zeros(len(encoder.model["scores"]), bool)
        byte_piece[encoder.model["byte_ids"]] = True
        for batch in batches:
            at = 0
            for part, data, offsets in pieces(pa.RecordBatch.from_arrays([batch.column(keep)], names=["text"]), "text", CHUNK):
                rows, at = batch.slice(at, part.num_rows), at + part.num_rows
                if part.num_rows == 1 and len(data) > CHUNK:
                    ids, one, whole = encoder.encode_long(data)
                    cuts, score, exact = np.array([0, len(ids)]), np.array([one]), np.array([whole])
                else:
                    ids, cuts, score = encoder.encode(data, offsets)
                    back, edges = encoder.decode(ids, cuts)
                    same = np.concatenate([[0], np.cumsum(data != back)]) if len(data) == len(back) else None
                    exact = (same[offsets[1:]] == same[offsets[:-1]]) & (edges[1:] == offsets[1:]) if same is not None else np.array([data[a:b].tobytes() == back[c:d].tobytes() for a, b, c, d in zip(offsets, offsets[1:], edges, edges[1:], strict=False)])
                fell = np.concatenate([[0], np.cumsum(byte_piece[ids])])
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(i) for i in range(keep)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), pa.array(np.diff(cuts)), pa.array(fell[cuts[1:]] - fell[cuts[:-1]]), pa.array(score), pa.array(exact)],
                    names=[*rows.schema.names[:keep], "ids", "n_tokens", "n_bytes", "score", "exact"])

    return run


def encode_pieces(docs: DataFrame, model: dict | None = None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row (all by default), with ``ids array<int>, n_tokens, n_bytes, score, exact``.

    n_bytes counts byte pieces; exact says whether decoding gives back the text, byte for byte. A null or
    empty text has no ids; rows that repeat get equal results; an empty table gives no rows. A long text is worked on
    in stretches, and only one over which pieces overlap all through is worked on whole. A kept column with the name
    of an added one is replaced. The model has a fixed size, the vocabulary's, and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or load_pieces())
    kept = docs.select(*(c for c in (keep if keep is not None else docs.columns) if c not in ENCODED.names))
    source = docs.select(*kept.columns, F.col(text).cast("string").alias(fresh("_text", kept.columns)))
    return source.mapInArrow(_encode(shared, len(kept.columns)), T.StructType([*kept.schema.fields, *ENCODED.fields]))


def _decode(shared, keep: int):
    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            column = batch.column(keep)
            column = column.fill_null([]) if column.null_count else column
            at = np.concatenate([[0], np.cumsum(np.array(column.value_lengths(), np.int64))]) if len(column) else np.zeros(1, np.int64)
            data, edges = encoder.decode(np.asarray(column.flatten(), np.int32), at)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(edges, edges[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(keep)), pa.array(texts, pa.string())], names=[*batch.schema.names[:keep], "decoded"])

    return run


def decode_pieces(encoded: DataFrame, model: dict | None = None, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every row and ``decoded``, the text of its ids; null ids decode to an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(model or load_pieces())
    kept = encoded.select(*(c for c in (keep if keep is not None else encoded.columns) if c != "decoded"))
    source = encoded.select(*kept.columns, F.col(ids).cast("array<int>").alias(fresh("_ids", kept.columns)))
    return source.mapInArrow(_decode(shared, len(kept.columns)), T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))
