"""N-gram Jaccard join by multiple-global-order filtering.

Sets are the distinct runs of five words of a text. Two sets with a Jaccard similarity of t or more share a
token within their prefixes, the first ``n - ceil(t n) + 1`` tokens, under every global order of all tokens.

1. A task gathers sets into a flush and deals their tokens out by hash; what a flush holds several times goes as
   one count. Where a token's counts meet, the number of sets that hold it is known; it goes back to the flushes.
   This join carries the counts to the sets: no table of tokens reaches the driver or all tasks.
2. Tokens that one set alone holds come first in all three orders; the others by classes of their count, finer or
   coarser, and by a hash that each order has of its own. A set whose prefix holds only tokens of its own is done.
3. Sets that are equal form a class, which its smallest id stands for. Prefix tokens of classes under the first
   order are joined: all pairs of up to ``SMALL`` classes of one token, else a star around one of them.
4. Candidates must fit in size, parity bits of their sets must leave it open that they are similar, and they must share
   prefix tokens under the second and under the third order. Only the sets of pairs that pass all of it move, and are verified.
5. Components of all links. Tokens with more classes, where not all are in one component yet, give all pairs
   across components, which go through the same filters. So no link between components is missed.
6. Pairs within a component that share a token with more classes are made only where links are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parallelism
from .components import connected_components
from .text import Words, mix, pieces, shingle_sets

SMALL = 8  # classes of one token that give all their pairs at once
PAIRED = 500  # classes of a token that one task pairs with all others of it
FLUSH = 600_000  # tokens that a task gathers at least before it deals them out
BUCKET_BYTES = 24_000_000  # tokens and owners that one task counts
WORDS = 16  # 64-bit words of parity
ORDERS = (0x51ED270B, 0xA24BAED4963EE407, 0x9FB21C651E98DF25)
CLASS = ["n", "s1", "s2"]
OWNERS = 1 << 16  # sets of a flush at most
DEALT = {"bucket": "bigint", "flush": "bigint", "lone": "binary", "many": "binary", "count": "binary", "owners": "binary", "ids": "array<bigint>", "facts": "binary"}
COUNTED = {"bucket": "bigint", "flush": "bigint", "lone": "binary", "level": "binary", "many_level": "binary", "many": "binary", "count": "binary", "owners": "binary", "ids": "array<bigint>", "facts": "binary"}
SETS = {"id": "bigint", "n": "bigint", "s1": "bigint", "s2": "bigint", "open": "boolean", "own": "bigint", "words": "array<bigint>", "shared": "array<bigint>", "p1": "array<bigint>", "p2": "array<int>", "p3": "array<int>"}


def ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in columns.items())


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Prefix length of a set of n tokens."""
    return n - (percent * n + 99) // 100 + 1


def _signatures(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums of differently mixed tokens, which stand for a set together with its size."""
    out = []
    for seed in (0x1234567, 0x7654321):
        sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(mix(tokens ^ np.uint64(seed)), dtype=np.uint64, out=sums[1:])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def _sets_of(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    words = Words(lower=True)
    for batch in batches:
        for rows, data, offsets in pieces(batch, "text"):
            _, _, hashes, at = words(data, offsets)
            yield rows, *shingle_sets(hashes, at, k)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """Rows in the order of keys (the last one counts most), and whether each then starts a run of equal ones."""
    order = np.lexsort(keys)
    start = np.ones(len(order), bool)
    if len(order):
        start[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, start


def cut(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of an array as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def join_cells(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Binary values as one array, and how many items each has; nulls have none."""
    cells = [x or b"" for x in column.to_pylist()]
    return np.frombuffer(b"".join(cells), kind), np.array([len(x) for x in cells], np.int64) // np.dtype(kind).itemsize


def pack(tokens: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """64 bits of a token and 16 of its owner in 10 bytes each."""
    out = np.zeros((len(tokens), 10), np.uint8)
    out[:, :8] = tokens.view(np.uint8).reshape(-1, 8)
    out[:, 8:] = owners.astype(np.uint16).view(np.uint8).reshape(-1, 2)
    return out.view("V10").reshape(-1)


def unpack(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, owners, and how many each value holds."""
    cells, sizes = join_cells(column, "V10")
    wide = cells.view(np.uint8).reshape(-1, 10)
    return np.ascontiguousarray(wide[:, :8]).view(np.uint64).reshape(-1), np.ascontiguousarray(wide[:, 8:]).view(np.uint16).reshape(-1), sizes


def table_of(columns: dict, kinds: dict[str, str], n: int) -> pa.Table:
    types = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "boolean": pa.bool_()}
    return pa.table({k: (columns[k] if isinstance(columns[k], pa.Array) else pa.array(columns[k], types[t])) if k in columns else pa.nulls(n, types[t]) for k, t in kinds.items()})


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    """Stretches of all hashes: buckets follow the order of tokens."""
    return ((token >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _deal(k: int, buckets: int, flush: int):
    """Tokens by bucket, and one row with the ids, sizes, signatures and repeated tokens of each flush."""

    def emit(number: int, held: list) -> pa.RecordBatch:
        ids = pa.concat_arrays([h[0] for h in held])
        n, one, two = (np.concatenate([h[i] for h in held]) for i in (1, 2, 3))
        tokens = np.concatenate([h[4] for h in held])
        named = np.asarray(ids.is_valid()) & (n > 0)
        # of equal sets of a flush, that of the smallest id holds the tokens
        plain = np.asarray(ids.fill_null(0), np.int64)
        order, start = _firsts(two, one, n, ~named)
        order = np.lexsort((plain, two, one, n, ~named))
        holder = np.zeros(len(n), bool)
        holder[order[start]] = True
        holder &= named
        own = np.repeat(np.arange(len(n), dtype=np.uint16), n)
        picked = holder[own]
        token, own = tokens[picked], own[picked]
        order = np.argsort(token, kind="stable")
        token, own = token[order], own[order]
        bucket = bucket_of(token, buckets)
        start = np.ones(len(token), bool)
        start[1:] = token[1:] != token[:-1]
        at = np.flatnonzero(start)
        size = np.diff(np.append(at, len(token)))
        alone, some = at[size == 1], at[size > 1]
        many, count = token[some], size[size > 1].astype(np.uint32)
        owners = own[np.repeat(size > 1, size)]
        lone = pack(token[alone], own[alone])
        by_lone, by_many = (np.searchsorted(bucket[x], np.arange(buckets + 1, dtype=np.uint64)) for x in (alone, some))
        cells = {"bucket": np.arange(buckets), "flush": np.full(buckets, number), "lone": cut(lone, by_lone), "many": cut(many, by_many), "count": cut(count, by_many)}
        full = np.flatnonzero((np.diff(by_lone) > 0) | (np.diff(by_many) > 0))
        facts = np.stack([n, one, two, holder.astype(np.int64)], axis=1)
        head = {
            "bucket": [number % buckets], "flush": [number], "many": [many.tobytes()], "count": [count.tobytes()], "owners": [owners.tobytes()],
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), "facts": [facts.tobytes()]}
        both = pa.concat_tables([table_of(cells, DEALT, buckets).take(pa.array(full)), table_of(head, DEALT, 1)])
        return both.combine_chunks().to_batches()[0]

    def run(batches):
        number, held, total, sets = TaskContext.get().partitionId() << 32, [], 0, 0
        for rows, tokens, at in _sets_of(batches, k):
            one, two = _signatures(tokens, at)
            for a in range(0, rows.num_rows, OWNERS):
                b = min(rows.num_rows, a + OWNERS)
                if held and (total >= flush or sets + b - a > OWNERS):
                    yield emit(number, held)
                    number, held, total, sets = number + 1, [], 0, 0
                held.append((rows.column(0).slice(a, b - a), np.diff(at[a : b + 1]), one[a:b], two[a:b], tokens[at[a] : at[b]]))
                total, sets = total + int(at[b] - at[a]), sets + b - a
        if held:
            yield emit(number, held)

    return run


def _count(table: pa.Table) -> pa.Table:
    """How many sets hold the tokens of one bucket, for those that two or more hold; what belongs to a flush passes."""
    head = table.filter(pa.compute.is_valid(table["facts"]))
    cells = table.filter(pa.compute.is_null(table["facts"]))
    token, owner, by_token = unpack(cells["lone"])
    many, by_many = join_cells(cells["many"], np.uint64)
    count, _ = join_cells(cells["count"], np.uint32)
    every, weight = np.concatenate([token, many]), np.concatenate([np.ones(len(token), np.int64), count])
    order = np.argsort(every, kind="stable")
    start = np.ones(len(every), bool)
    start[1:] = every[order][1:] != every[order][:-1]
    at = np.flatnonzero(start)
    total = np.add.reduceat(weight[order], at) if len(at) else np.zeros(0, np.int64)
    level = np.zeros(len(every), np.uint8)
    level[order] = np.ceil(np.log2(total)).astype(np.uint8)[np.cumsum(start) - 1]
    one, more = level[: len(token)], level[len(token) :]
    kept = one > 0
    bounds = np.concatenate([[0], np.cumsum(kept)])[np.concatenate([[0], np.cumsum(by_token)])]
    by_many = np.concatenate([[0], np.cumsum(by_many)])
    back = table_of({
        "bucket": cells["bucket"].combine_chunks(), "flush": cells["flush"].combine_chunks(), "lone": cut(pack(token[kept], owner[kept]), bounds), "level": cut(one[kept], bounds),
        "many_level": cut(more, by_many)}, COUNTED, cells.num_rows)
    passed = table_of({c: head[c].combine_chunks() for c in ("flush", "many", "count", "owners", "ids", "facts")}, COUNTED, head.num_rows)
    return pa.concat_tables([back, passed])


def parity_words(tokens: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """For each of n sets and 64 * WORDS places, whether an odd number of its tokens falls there, as n x WORDS integers."""
    out = np.zeros((n, WORDS), np.int64)
    bounds = np.searchsorted(own, np.arange(0, n + 2000, 2000))
    for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        rows = min(2000, n - 2000 * i)
        place = (own[a:b] - 2000 * i) * (64 * WORDS) + (tokens[a:b] & np.uint64(64 * WORDS - 1)).astype(np.int64)
        odd = np.bincount(place, minlength=rows * 64 * WORDS) & 1
        out[2000 * i : 2000 * i + rows] = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64).reshape(rows, WORDS)
    return out


def _assemble(percent: int):
    """All rows of a flush; those that may be similar to others with their shared tokens and prefixes."""

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_valid(table["facts"]))
        cells = table.filter(pa.compute.is_null(table["facts"])).sort_by("bucket")
        ids = head["ids"].combine_chunks().flatten()
        n, one, two, holder = np.frombuffer(head["facts"][0].as_py(), np.int64).reshape(-1, 4).T
        (token, own, _), level = unpack(cells["lone"]), join_cells(cells["level"], np.uint8)[0]
        many, count, owners = (join_cells(head[c], t)[0] for c, t in (("many", np.uint64), ("count", np.uint32), ("owners", np.uint16)))
        known = join_cells(cells["many_level"], np.uint8)[0]  # repeated tokens are in order of buckets, here as there
        token, own, level = np.concatenate([token, np.repeat(many, count)]), np.concatenate([own, owners]).astype(np.int64), np.concatenate([level, np.repeat(known, count)]).astype(np.uint64)
        shared = np.bincount(own, minlength=len(n))
        free = need(n, percent) - (n - shared)  # places in the prefix that tokens of other sets, too, can take
        open_ = (holder > 0) & (free > 0) & (shared > 0)
        own, token, level = (x[open_[own]] for x in (own, token, level))
        order = np.lexsort((token, own))
        own, token, level = own[order], token[order], level[order]
        size = np.bincount(own, minlength=len(n))
        first = np.concatenate([[0], np.cumsum(size)])
        lists = lambda values, sizes: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values.view(np.int64)))

        def prefix(seed: int, rank: np.ndarray, short: bool = False) -> pa.Array:
            place = mix(token ^ np.uint64(seed))
            order = np.lexsort((place, rank, own))
            within = np.arange(len(own)) - first[own] < free[own]
            found, sizes = (place if short else token)[order][within], np.minimum(size, np.maximum(free, 0))
            # what only filters needs no more than 32 bits
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(found.astype(np.uint32).view(np.int32))) if short else lists(found, sizes)

        which = np.flatnonzero(open_)
        words = parity_words(token, np.searchsorted(which, own), len(which))
        return table_of({
            "id": ids, "n": n, "s1": one, "s2": two, "open": open_, "own": n - shared, "words": lists(words.reshape(-1), np.where(open_, WORDS, 0)), "shared": lists(token, size),
            "p1": prefix(ORDERS[0], level), "p2": prefix(ORDERS[1], (level + np.uint64(1)) // np.uint64(2), True), "p3": prefix(ORDERS[2], level > 3, True)}, SETS, len(n))

    return run


def _fits(percent: int, left: str = "a", right: str = "b") -> Column:
    """Sizes that allow the similarity."""
    x, y = F.col(f"n{left}"), F.col(f"n{right}")
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _words_allow(percent: int) -> Column:
    """Whether own tokens and parity words of two sets leave it open that they are similar: they bound from below how many tokens the two do not share."""
    apart = sum((F.bit_count(F.col("wordsa")[i].bitwiseXOR(F.col("wordsb")[i])) for i in range(WORDS)), F.col("owna") + F.col("ownb"))
    return _fits(percent) & (apart * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent))


def _sides(pairs: DataFrame, nodes: DataFrame, columns: list[str], condition: Column) -> DataFrame:
    """Pairs a, b, of a written table, whose nodes' columns, named with a or b at the end, meet the condition."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = nodes.select("node", *columns).join(named, "node", "left_semi")
    side = lambda c: asked.select(F.col("node").alias(c), *(F.col(x).alias(f"{x}{c}") for x in columns))
    right = side("b").withColumnRenamed("b", "_b")
    left = pairs.join(side("a"), "a")
    return left.join(right, (left["b"] == right["_b"]) & condition).select("a", "b").distinct()


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that sizes and parity leave."""
    return _sides(pairs, nodes, ["n", "own", "words"], _words_allow(percent))


def _met(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs that share prefix tokens under the second and under the third order, too."""
    return _sides(pairs, nodes, ["p2", "p3"], F.arrays_overlap("p2a", "p2b") & F.arrays_overlap("p3a", "p3b"))


def _verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the similarity. Tokens that one set alone holds are in no intersection."""
    both = F.size(F.array_intersect("shareda", "sharedb"))
    return _sides(pairs, nodes, ["n", "shared"], both * 100 >= (F.col("na") + F.col("nb") - both) * percent)


def _paired(members: DataFrame, facts: DataFrame, percent: int, same: bool) -> DataFrame:
    """Pairs of one component, or of different ones, that share a token.

    A token's members are dealt out in parts of about ``PAIRED``, each of which meets all of them. Pairs of one
    component, which share many tokens, are each made at the smallest of them.
    """
    many = members.groupBy("token").agg(F.ceil(F.count("*") / PAIRED).cast("int").alias("salts"))
    full = members.join(many, "token").join(facts, "node")
    names = ["token", "comp", "n", "own", "words"]
    if same:
        full = full.join(members.groupBy("node").agg(F.collect_set("token").alias("tokens")), "node")
        names.append("tokens")
    side = lambda c: (F.col("node").alias(c), *(F.col(x).alias(f"{x}{c}") for x in names))
    x = full.select(*side("a"), F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("sa"))
    y = full.select(*side("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("sb"))
    apart = (F.col("compa") == F.col("compb")) if same else (F.col("compa") != F.col("compb"))
    fits = apart & (F.col("a") < F.col("b")) & _words_allow(percent)
    if same:
        fits = fits & (F.array_min(F.array_intersect("tokensa", "tokensb")) == F.col("tokena"))
    return x.join(y, (F.col("tokena") == F.col("tokenb")) & (F.col("sa") == F.col("sb")) & fits).select("a", "b").distinct()


class _Join:
    """The steps of one join; tables of a step stay until ``scratch.last``."""

    def __init__(self, docs: DataFrame, id_col: str, text: str, k: int, percent: int, buckets: int | None) -> None:
        self.id_col, self.percent = id_col, percent
        self.scratch = scratch = Scratch(docs.sparkSession, "jaccard")
        texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        if buckets is None:  # a token takes about 10 bytes where a word with its gap takes 6
            size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
            buckets = max(parallelism(docs.sparkSession), int(size * 10 / 6 / BUCKET_BYTES) + 1)
        flush = max(FLUSH, min(10 * FLUSH, 16 * buckets))
        # a task that runs again must fill its flushes with the same rows, also where they come from a shuffle
        texts = texts.sortWithinPartitions("id", F.xxhash64("text"))
        # the tables and shuffles of early steps are let go as soon as the next step is written
        dealt = texts.mapInArrow(_deal(k, buckets, flush), ddl(DEALT)).repartition(buckets, "bucket")
        counted = dealt.groupBy("bucket").applyInArrow(_count, ddl(COUNTED)).repartition(buckets, "flush")
        every = scratch.save(counted.groupBy("flush").applyInArrow(_assemble(percent), ddl(SETS)), "every")
        del dealt, counted
        self.sets = scratch.save(every.select("id", *CLASS), "sets")
        # also holders that are not the smallest of their class: no pair names them
        self.nodes = every.filter("open").withColumnRenamed("id", "node")
        named = self.sets.filter("id is not null")
        # written, so that what joins it is dealt anew and large classes can be split
        self.classes = scratch.save(named.filter("n > 0").groupBy(*CLASS).agg(F.min("id").alias("rep")), "classes")
        holders = self.nodes.select("node", *CLASS, "p1").join(self.classes.withColumnRenamed("rep", "node"), ["node", *CLASS], "left_semi")
        key = F.struct(*CLASS)
        self.repeated = named.groupBy("id").agg(F.min(key).alias("x"), F.max(key).alias("y")).filter("x <> y").select("id")
        self.of_id = scratch.save(named.filter("n > 0").join(self.repeated, "id").join(self.classes, CLASS).select("id", "rep").distinct(), "repeated")
        least = self.of_id.groupBy("id").agg(F.min("rep").alias("a"))
        self.again = self.of_id.join(least, "id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct()

        posts = holders.select("node", "n", F.explode("p1").alias("token"))
        tokens = scratch.save(posts.groupBy("token").agg(F.count("*").alias("m"), F.min(F.struct("node", "n")).alias("c")).filter("m > 1"), "tokens")
        self.posts = scratch.save(posts.join(tokens, "token"), "posts")
        few = self.posts.filter(F.col("m") <= SMALL)
        x, y = (few.select("token", F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
        close = x.join(y, "token").filter((F.col("a") < F.col("b")) & _fits(percent)).select("a", "b")
        star = self.posts.filter(F.col("m") > SMALL).select(F.col("c.node").alias("a"), F.col("node").alias("b"), F.col("c.n").alias("na"), F.col("n").alias("nb"))
        star = star.filter((F.col("a") < F.col("b")) & _fits(percent)).select("a", "b")
        self.tried = scratch.save(close.union(star).distinct(), "pairs")
        left = scratch.save(_likely(self.tried, self.nodes, percent), "left")
        self.links = scratch.save(self._filtered(left, "met"), "links")
        comps = connected_components(self.links.union(self.again), scratch, "first")

        self.facts = self.nodes.select("node", "n", "own", "words")
        members = self.posts.filter(F.col("m") > SMALL).select("token", "node").distinct().join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        self.members = scratch.save(members, "members")
        split = self.members.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token")
        open_ = scratch.save(self.members.join(split, "token", "left_semi"), "open")
        across = scratch.save(_paired(open_, self.facts, percent, same=False).join(self.tried, ["a", "b"], "left_anti"), "across")
        if not across.isEmpty():
            more = scratch.save(self._filtered(across, "met-across"), "more")
            self.links = self.links.union(more)
            comps = connected_components(self.links.union(self.again), scratch, "second")
        self.comps = comps.withColumnRenamed("node", "rep")

    def _filtered(self, pairs: DataFrame, name: str) -> DataFrame:
        """What the other orders leave is written; only the sets that it names move."""
        return _verified(self.scratch.save(_met(pairs, self.nodes), name), self.nodes, self.percent)

    def groups(self) -> DataFrame:
        of_class = self.classes.join(self.comps, "rep", "left").select(*CLASS, F.coalesce("comp", "rep").alias("_comp"))
        of_id = self.of_id.join(self.comps, "rep", "left").groupBy("id").agg(F.min(F.coalesce("comp", "rep")).alias("_again"))
        of_class = self.scratch.save(of_class, "components")
        found = self.sets.select("id", *CLASS).join(of_class, CLASS, "left").join(of_id, "id", "left")
        comp = F.when(F.col("id").isNotNull(), F.coalesce("_again", "_comp", "id"))
        return found.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"))

    def all_links(self) -> DataFrame:
        """Links, those within components included."""
        within = self.scratch.save(_paired(self.members, self.facts, self.percent, same=True).join(self.tried, ["a", "b"], "left_anti"), "within")
        return self.links.union(self._filtered(within, "met-within")).distinct()


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, buckets: int | None = None) -> DataFrame:
    """``(id_col, n_shingles, component_id)`` for each row of docs; component_id is the smallest id that links reach.

    Rows with a null id or without words are linked with nothing; a null id gives a null component. Rows that
    repeat an id are one document that links where one of its texts does. Texts of fewer than k words are one run.
    Columns besides id and text are ignored; an empty table gives no rows. Ids are whole numbers, or texts of such. A long text takes about ten times its
    size in one task. ``buckets`` deals out the tokens; by default it follows the bytes of text, and no result depends on it. The
    result is a table in the shared folder; all others that the join wrote are removed.
    """
    join = _Join(docs, id_col, text, k, percent, buckets)
    return join.scratch.last(join.groups())


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """What jaccard_groups gives, and all links ``a, b``, a < b: of all representatives of classes of equal sets that
    reach the similarity, and of the classes of an id that repeats."""
    join = _Join(docs, id_col, text, k, percent, buckets)
    out = join.scratch.save(join.groups(), "groups")
    links = join.scratch.save(join.all_links().union(join.again).distinct(), "all-links")
    join.scratch.drop(*(n for n in list(join.scratch.names) if n not in ("groups", "all-links")))
    return out, links


def link_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75, buckets: int | None = None) -> DataFrame:
    """``(id_col, n_links)`` for each id with words: how many classes of other sets reach the similarity with its own."""
    join = _Join(docs, id_col, text, k, percent, buckets)
    links = join.all_links()
    ends = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).union(links.select("b", "a"))
    reps = join.sets.filter("id is not null").join(join.classes, CLASS).select("id", "rep").distinct()
    own = join.of_id.select("id", F.col("rep").alias("other"))
    met = reps.join(ends, "rep").select("id", "other").distinct().join(own, ["id", "other"], "left_anti")
    counts = met.groupBy("id").agg(F.count("*").alias("n"))
    return join.scratch.last(reps.select("id").distinct().join(counts, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links")))
