"""One query for each operator over the derived peer states and logs, with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .fixtures import Fixtures, with_tables
from .functions import digests, display, paths
from .operators import actions, ancestry, contents, edits, lineage, logset, merge, rotation, snapshot, textmerge, views
from .operators.exchange import exchanged_rows
from .operators.merkle import state_difference as differing_entries
from .operators.merkle import store_state
from .operators.order import numbered
from .plans.apply import apply_plan
from .plans.commit import commit
from .plans.scratch import keep, run, within
from .plans.mesh import chain, converge, sync_until_stable
from .plans.sync import MARK, PeerState, SyncOptions, arriving, plan_sync, sync
from .schema import BASE_CAP, ROTATE_AT
from .sources.adapter import FolderAdapter, file_digests, range_digests, register_folders, tree_digests, walk_store, write_files
from .sources.feed import external_changes
from .sources.files import encode_entries, encode_rows, list_dir, stat
from .sources.manifest import open_table
from .sources.segments import SegmentedLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[Fixtures], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- entries, digests and logs ---


@query(with_tables("base", "b") + "select uuid, path, hash, size from b where not deleted")
def live_entries(fx: Fixtures) -> DataFrame:
    return views.live(fx.b).select("uuid", "path", "hash", "size")


@query(with_tables("base", "a") + "select uuid, path, row_number() over (partition by split_part(path, '/', 1) order by path, uuid) as place from a")
def canonical_sort(fx: Fixtures) -> DataFrame:
    top = F.split_part(F.col("path"), F.lit("/"), F.lit(1))
    return fx.a.select("uuid", "path", F.row_number().over(Window.partitionBy(top).orderBy("path", "uuid")).alias("place"))


_JSON = """'{"hash":"' || hash || '","kind":"file","path":"' || path || '","size":' || size || ',"updated":' || updated || ',"uuid":"' || uuid || '"}'"""


@query(with_tables("base", "a", "b") + f""", e as (select peer as store, path, uuid, {_JSON} as j from a where not deleted union all select peer, path, uuid, {_JSON} from b where not deleted)
select store, sha256('[' || string_agg(j, ',' order by path, uuid) || ']') as state from e group by store""")
def state_digest_by_store(fx: Fixtures) -> DataFrame:
    e = views.live(fx.a.unionByName(fx.b))
    j = digests.entry_json(*(F.col(c) for c in ("kind", "path", "hash", "size", "updated", "uuid")))
    return e.groupBy(F.col("peer").alias("store")).agg(digests.state_digest(F.col("path"), F.col("uuid"), j).alias("state"))


_XOR = " || ".join(f"printf('%08x', bit_xor(cast(('0x' || substr(op, {1 + 8 * i}, 8)) as bigint)))" for i in range(8))


@query(with_tables("base", "a", "b") + f""", e as (select peer as store, sha256({_JSON}) as op from (select * from a union all select * from b) where not deleted) select store, {_XOR} as digest from e group by store""")
def set_digest_by_store(fx: Fixtures) -> DataFrame:
    """The digest that syncing compares: it combines before the shuffle, so a store of any size is one small row a task."""
    e = views.live(fx.a.unionByName(fx.b))
    j = digests.entry_json(*(F.col(c) for c in ("kind", "path", "hash", "size", "updated", "uuid")))
    return e.groupBy(F.col("peer").alias("store")).agg(digests.mergeable_digest(j).alias("digest"))


@query(with_tables("log") + "select event_id, op from log")
def op_ids(fx: Fixtures) -> DataFrame:
    return logset.with_op(fx.log.drop("op")).select("event_id", "op")




@query(with_tables("log") + f"select peer, count(*) as rows, {_XOR} as digest from log group by peer")
def log_xor_digest(fx: Fixtures) -> DataFrame:
    return logset.log_mark(fx.log, "peer")


@query(with_tables("log") + "select op, uuid, type, at_ms, batch from log")
def log_union(fx: Fixtures) -> DataFrame:
    log = fx.log
    columns = ("op", "uuid", "type", "at_ms", "batch")
    return logset.union_rows(log.filter("event_id % 3 <> 1").select(*columns), log.filter("event_id % 3 <> 0").select(*columns))


@query(with_tables("log") + "select op, uuid from log where event_id % 3 = 1")
def log_missing_rows(fx: Fixtures) -> DataFrame:
    log = fx.log
    return logset.missing_rows(log.filter("event_id % 3 <> 1"), log.filter("event_id % 3 <> 0")).select("op", "uuid")


@query(with_tables("log") + "select uuid, op, row_number() over (partition by uuid order by at_ms, op) as version from log")
def file_history(fx: Fixtures) -> DataFrame:
    return logset.file_history(fx.log).select("uuid", "op", "version")


@query(with_tables("log") + "select op, at_ms, event_id from log order by at_ms desc, op desc limit 50")
def log_last_rows(fx: Fixtures) -> DataFrame:
    return fx.log.orderBy(F.desc("at_ms"), F.desc("op")).limit(50).select("op", "at_ms", "event_id")


@query(with_tables("log") + "select uuid, max(at_ms) as last_ms, arg_max(type = 'delete', (at_ms, op)) as last_deleted, arg_max(path, (at_ms, op)) as last_path from log group by uuid")
def latest_per_uuid(fx: Fixtures) -> DataFrame:
    return logset.latest(fx.log)


@query(with_tables("base", "a", "b") + """, u as (select *, 0 as now from a union all select *, 1 from b)
select uuid, path, hash, updated, deleted from (select *, row_number() over (partition by uuid order by updated desc, now desc) as place from u) where place = 1""")
def cumulative_snapshot(fx: Fixtures) -> DataFrame:
    return logset.cumulative_snapshot(fx.a, fx.b).select("uuid", "path", "hash", "updated", "deleted")


@query(with_tables("log") + f""", s as (select *, at_ms // 86400000 as segment from log)
select segment, count(*) as rows, min(at_ms) as min_at, max(at_ms) as max_at, {_XOR} as digest from s group by segment""")
def segment_counts(fx: Fixtures) -> DataFrame:
    return logset.segments(_segmented(fx))


def _segmented(fx: Fixtures) -> DataFrame:
    return fx.log.withColumn("segment", F.floor(F.col("at_ms") / 86_400_000).cast("bigint"))


@query(with_tables("log") + "select op, at_ms // 86400000 as segment from log where at_ms // 86400000 in (select at_ms // 86400000 as s from log group by s having max(at_ms) >= 1704400000000)")
def archives_since(fx: Fixtures) -> DataFrame:
    return logset.archives_since(_segmented(fx), 1_704_400_000_000).select("op", "segment")


@query(with_tables("log") + "select batch, count(*) as rows, string_agg(distinct type, ',' order by type) as types from log group by batch")
def batch_summary(fx: Fixtures) -> DataFrame:
    return logset.batch_summary(fx.log)


@query(with_tables("log") + f""", s as (select at_ms // 86400000 as segment, octet_length(encode(
 '{{"at":' || at_ms || ',"batch":"' || batch || '",' || case when hash is null then '' else '"hash":"' || hash || '",' end || '"op":"' || op || '","path":"' || path || '"}}')) + 1 as n from log)
select segment, cast(sum(n) as bigint) as bytes, sum(n) > {ROTATE_AT} as rotate from s group by segment""")
def rotation_due(fx: Fixtures) -> DataFrame:
    s = _segmented(fx)
    width = F.octet_length(encode_width(s)) + 1
    return s.groupBy("segment").agg(F.sum(width).cast("bigint").alias("bytes")).withColumn("rotate", F.col("bytes") > ROTATE_AT)


def encode_width(log: DataFrame):
    return F.to_json(F.struct(F.col("at_ms").alias("at"), "batch", "hash", "op", "path"))


@query(with_tables("log") + """select '{"at":' || at_ms || ',' || case when hash is null then '' else '"hash":"' || hash || '",' end || '"op":"' || op || '"}' as value from log""")
def log_encoding(fx: Fixtures) -> DataFrame:
    return encode_rows(fx.log.select("at_ms", "hash", "op"))


@query(with_tables("base", "b", "log_ab") + """, m as (select 1700000500000 as floor), p as (select uuid from log_ab where type = 'delete' union select uuid from b where deleted and updated % 3000 = 200)
select uuid, deleted from b, m where not (deleted and updated < floor and uuid in (select uuid from p))""")
def prune_tombstones(fx: Fixtures) -> DataFrame:
    marks = fx.spark.createDataFrame([("x", 1_700_000_900_000), ("y", 1_700_000_500_000)], "peer string, last_sync bigint")
    snap = fx.b.filter("deleted and updated % 3000 = 200")
    return logset.prune_tombstones(fx.b, fx.log_ab, marks, snap).select("uuid", "deleted")


@query(with_tables("base", "a") + f"select store, hash from (select split_part(path, '/', 1) as store, hash, row_number() over (partition by split_part(path, '/', 1) order by updated desc, hash) as place from a) where place <= {BASE_CAP}")
def base_retention(fx: Fixtures) -> DataFrame:
    bases = fx.a.select(F.split_part(F.col("path"), F.lit("/"), F.lit(1)).alias("store"), "hash", F.col("updated").alias("mtime"))
    return logset.newest_bases(bases, BASE_CAP).select("store", "hash")


# --- ancestry ---

_REACH = """, e as (select distinct uuid, hash, prev as parent from log where hash is not null and prev is not null)
, r as (select uuid, hash, parent as ancestor, 1 as depth from e union select r.uuid, r.hash, e.parent, r.depth + 1 from r join e on e.uuid = r.uuid and e.hash = r.ancestor)
, m as (select uuid, hash, ancestor, min(depth) as depth from r group by uuid, hash, ancestor)
"""


def _recursive(sql: str) -> str:
    return sql.replace("with ", "with recursive ", 1)


@query(_recursive(with_tables("log")) + _REACH + "select m.* from m join (select uuid, arg_max(hash, (at_ms, event_id)) as hash from log where hash is not null group by uuid) h on h.uuid = m.uuid and h.hash = m.hash")
def ancestry_closure(fx: Fixtures) -> DataFrame:
    """All that the newest version of each file comes from."""
    log = fx.log.filter("hash is not null")
    heads = log.groupBy("uuid").agg(F.max_by("hash", F.struct("at_ms", "event_id")).alias("start")).withColumn("node", F.col("start"))
    up = ancestry.climb(heads, ancestry.version_edges(log), paths=False).filter("depth > 0")
    return up.select("uuid", F.col("start").alias("hash"), F.col("node").alias("ancestor"), "depth")


@query(_recursive(with_tables("log")) + _REACH + """, v as (select uuid, hash, prev, lag(hash, 3) over (partition by uuid order by at_ms, event_id) as ancestor from log)
select v.uuid, v.hash, v.ancestor, v.ancestor is not null and (v.hash is not distinct from v.ancestor or v.prev is not distinct from v.ancestor or exists (select 1 from m where m.uuid = v.uuid and m.ancestor = v.ancestor and (m.hash = v.hash or m.hash = v.prev))) as descends from v""")
def descends(fx: Fixtures) -> DataFrame:
    third = F.lag("hash", 3).over(Window.partitionBy("uuid").orderBy("at_ms", "event_id"))
    pairs = fx.log.select("uuid", "hash", "prev", F.lit(None).cast("string").alias("prev2"), third.alias("ancestor"))
    return ancestry.descends(pairs, ancestry.version_edges(fx.log)).select("uuid", "hash", "ancestor", "descends")


@query(_recursive(with_tables("log")) + _REACH + """, p as (select uuid, hash as left, lag(hash, 2) over (partition by uuid order by at_ms, event_id) as right from log where hash is not null)
, c as (select p.uuid, p.left, p.right, arg_min(x.ancestor, (x.depth, y.depth, x.ancestor)) as base from p join m x on x.uuid = p.uuid and x.hash = p.left join m y on y.uuid = p.uuid and y.hash = p.right and y.ancestor = x.ancestor group by 1, 2, 3)
select p.uuid, p.left, p.right, c.base from p left join c on c.uuid = p.uuid and c.left = p.left and c.right = p.right where p.right is not null""")
def common_ancestor(fx: Fixtures) -> DataFrame:
    log = fx.log.filter("hash is not null")
    second = F.lag("hash", 2).over(Window.partitionBy("uuid").orderBy("at_ms", "event_id"))
    pairs = log.select("uuid", F.col("hash").alias("left"), second.alias("right")).filter("right is not null")
    return ancestry.common_ancestor(pairs, ancestry.version_edges(fx.log)).select("uuid", "left", "right", "base")


@query(_recursive(with_tables("log")) + """, e as (select distinct uuid, hash, prev as parent from log where hash is not null and prev is not null and hash <> prev)
, n as (select uuid, hash, sum(ups) as ups, sum(downs) as downs from (select uuid, hash, 1 as ups, 0 as downs from e union all select uuid, parent, 0, 1 from e) group by uuid, hash)
, inner_ as (select e.uuid, e.hash, e.parent from e join n c on c.uuid = e.uuid and c.hash = e.hash and c.ups = 1 join n p on p.uuid = e.uuid and p.hash = e.parent and p.downs = 1)
, r as (select uuid, hash, hash as run, 0::bigint as place from n where (uuid, hash) not in (select (uuid, hash) from inner_)
 union all select i.uuid, i.hash, r.run, r.place + 1 from r join inner_ i on i.uuid = r.uuid and i.parent = r.hash)
select * from r""")
def history_runs(fx: Fixtures) -> DataFrame:
    """Every version's run and place, of a log that is added in two parts."""
    edges = ancestry.version_edges(fx.log)
    early = ancestry.version_edges(fx.log.filter("event_id % 10 < 7"))
    kept = lineage.Lineage(fx.spark, f"{within(fx.spark, 'lineage').root}/kept")
    kept.append(early)
    kept.append(edges)
    return kept.versions().select("uuid", "hash", "run", "place")


@query(ORACLE_SQL["descends"])
def descends_by_runs(fx: Fixtures) -> DataFrame:
    third = F.lag("hash", 3).over(Window.partitionBy("uuid").orderBy("at_ms", "event_id"))
    pairs = fx.log.select("uuid", "hash", "prev", F.lit(None).cast("string").alias("prev2"), third.alias("ancestor"))
    return lineage.descends(pairs, lineage.runs(ancestry.version_edges(fx.log))).select("uuid", "hash", "ancestor", "descends")


@query(ORACLE_SQL["common_ancestor"])
def ancestor_by_runs(fx: Fixtures) -> DataFrame:
    log = fx.log.filter("hash is not null")
    second = F.lag("hash", 2).over(Window.partitionBy("uuid").orderBy("at_ms", "event_id"))
    pairs = log.select("uuid", F.col("hash").alias("left"), second.alias("right")).filter("right is not null")
    return lineage.common_ancestor(pairs, lineage.runs(ancestry.version_edges(fx.log))).select("uuid", "left", "right", "base")


@query(with_tables("base", "a", "b") + "select a.uuid, a.prev_path is not distinct from b.path as moved from a join b on a.uuid = b.uuid where a.path <> b.path")
def moved_from(fx: Fixtures) -> DataFrame:
    both = fx.a.alias("a").join(fx.b.alias("b"), "uuid").filter("a.path <> b.path")
    pairs = both.select("uuid", F.col("a.path").alias("path"), F.col("a.prev_path").alias("seed"), F.col("b.path").alias("target"))
    moves = ancestry.location_edges(fx.a, fx.b)
    return ancestry.moved_from(pairs, moves).select("uuid", "moved")


# --- merging ---


@query(with_tables("base", "a", "b") + "select coalesce(a.uuid, b.uuid) as uuid, a.hash as hash_a, b.hash as hash_b from a full outer join b on a.uuid = b.uuid")
def pair_by_uuid(fx: Fixtures) -> DataFrame:
    return merge.pair_by_uuid(fx.a, fx.b).select("uuid", F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"))


@query(with_tables("base", "a", "b") + """, p as (select least(a.uuid, b.uuid) as uuid, a.uuid as ua, b.uuid as ub, a.hash as hash_a, b.hash as hash_b from a join b on a.uuid = b.uuid or (a.kind = b.kind and a.path = b.path and a.uuid <> b.uuid
 and not b.deleted and a.uuid not in (select uuid from b) and b.uuid not in (select uuid from a)))
select uuid, hash_a, hash_b from p union all select uuid, hash, null from a where uuid not in (select ua from p) union all select uuid, null, hash from b where uuid not in (select ub from p)""")
def pair_fallback_path(fx: Fixtures) -> DataFrame:
    pairs = merge.pair_by_path(merge.pair_by_uuid(fx.a, fx.b), fx.a, fx.b)
    return pairs.select("uuid", F.col("a.hash").alias("hash_a"), F.col("b.hash").alias("hash_b"))


@query(with_tables("base", "a", "b") + """, x as (select a.hash as ha, b.hash as hb, a.prev as pa, b.prev as pb, a.uuid as ua, b.uuid as ub, coalesce(a.deleted, false) as da, coalesce(b.deleted, false) as db from a full outer join b on a.uuid = b.uuid)
select case when ub is null then 'only_a' when ua is null then 'only_b' when ha is not distinct from hb and da = db then 'same_content'
 when (hb is not null and pa is not distinct from hb) or (ha is not null and pb is not distinct from ha) then 'propagate' when da or db then 'delete-edit' else 'content' end as status, count(*) as n from x group by 1""")
def merge_status(fx: Fixtures) -> DataFrame:
    """How every uuid of two peers stands, from its entries alone."""
    a, b = F.col("a"), F.col("b")
    same = a["hash"].eqNullSafe(b["hash"]) & (a["deleted"] == b["deleted"])
    down = lambda x, y: y["hash"].isNotNull() & x["prev"].eqNullSafe(y["hash"])
    status = (
        F.when(b.isNull(), "only_a").when(a.isNull(), "only_b").when(same, "same_content").when(down(a, b) | down(b, a), "propagate")
        .when(a["deleted"] | b["deleted"], "delete-edit").otherwise("content")
    )
    return merge.pair_by_uuid(fx.a, fx.b).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


def merged(fx: Fixtures, options: merge.MergeOptions | None = None) -> tuple[DataFrame, DataFrame]:
    return _merged(fx.a, fx.b, fx.log_ab, options)


def _merged(a: DataFrame, b: DataFrame, log: DataFrame, options: merge.MergeOptions | None = None) -> tuple[DataFrame, DataFrame]:
    rows = log.withColumns({"op": F.concat_ws("|", "uuid", "at_ms"), "prev_path": F.lit(None).cast("string")})
    edges = ancestry.version_edges(merge.entry_rows(a), merge.entry_rows(b), rows)
    moves = ancestry.location_edges(a, b)
    return merge.merge_entries(a, b, edges, moves, logset.latest(rows), a.select("uuid"), b.select("uuid"), options)


#: What each scenario of the fixtures must lead to.
EXPECTED = with_tables("base") + """, t as (
 select case when k in (10, 11) then alt else uuid end as uuid, case when k in (6, 12) then 'moved/' || p when k = 7 then 'moved/b/' || p else p end as path,
  case when k in (8, 9, 13) then null when k in (3, 15) then ha when k in (4, 5, 11, 12, 14) then hb else h0 end as hash,
  case when k in (8, 9, 13) then 0 when k in (3, 4, 5, 11, 12, 14, 15) then n + 2 else n end as size,
  case when k in (3, 6, 15) then t0 + 100 when k in (4, 5, 7, 8, 9, 11, 12, 14) then t0 + 200 when k = 13 then t0 + 50 else t0 end as updated,
  case when k in (2, 3, 6, 13, 15) then 'device-a' else 'device-b' end as peer, k in (8, 9, 13) as deleted,
  case when k in (3, 4, 5, 8, 9, 12, 13, 14) then h0 when k = 15 then hm end as prev, case when k in (6, 7, 12) then p end as prev_path, cast(null as varchar) as conflict_of from base
 union all
 select 'conflict:' || case k when 4 then uuid else alt end || ':' || case k when 4 then ha else h0 end, regexp_replace(p, '\\.[^.]*$', '') || ' (conflict device-a ' || substr(case k when 4 then ha else h0 end, 1, 8) || ')' || regexp_extract(p, '\\.[^.]*$'),
  case k when 4 then ha else h0 end, case k when 4 then n + 2 else n end, case k when 4 then t0 + 100 else t0 end, 'device-a', false, null, null, case k when 4 then uuid else alt end from base where k in (4, 11))
"""


@query(EXPECTED + "select * from t")
def merge_entries(fx: Fixtures) -> DataFrame:
    return merged(fx)[0].select("uuid", "path", "hash", "size", "updated", "peer", "deleted", "prev", "prev_path", "conflict_of")


@query(with_tables("base") + """select case when k in (11) then alt else uuid end as uuid, case k when 7 then 'location' when 9 then 'delete-edit' else 'content' end as kind, 'b' as winner,
 k in (4, 11) and p not like '%.bin' as is_text, k in (4, 11) as has_copy from base where k in (4, 7, 9, 11)
 union all select uuid, 'location', 'a', false, false from base where doc_id % 32 = 6""")
def merge_conflicts(fx: Fixtures) -> DataFrame:
    return merged(fx)[1].select("uuid", "kind", "winner", "is_text", F.col("copy").isNotNull().alias("has_copy"))


@query(with_tables("base") + """select 'conflict:' || case k when 11 then alt else uuid end || ':' || case k when 11 then h0 else ha end as copy, case k when 9 then 'delete-edit' else 'binary' end as reason, case k when 11 then null else h0 end as base from base where k in (4, 9, 11)""")
def conflict_copies(fx: Fixtures) -> DataFrame:
    entries = merged(fx, merge.MergeOptions(copies="always"))[0].filter("conflict_of is not null")
    return entries.select(F.col("uuid").alias("copy"), "reason", "base")


@query(with_tables("base") + "select uuid, t0 + 50 as updated, h0 as prev from base where k = 13")
def solo_resurrection_guard(fx: Fixtures) -> DataFrame:
    rows = fx.log_ab.withColumn("op", F.col("uuid"))
    solo = merge.solo_rows(merge.pair_by_uuid(fx.a, fx.b), logset.latest(rows))
    return solo.filter("deleted and peer = 'device-a'").select("uuid", "updated", "prev")


_NESTED = with_tables("base", "a") + """, c as (select distinct split_part(path, '/', 1) as s from a), f as (select s from c where s like '%3' or s = 'moved')
, d as (select distinct split_part(path, '/', 1) as s, split_part(path, '/', 2) as l, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as d from a), g as (select d from d where l = 'en')
, e as (select uuid, path as pos, split_part(path, '/', 1) as s, split_part(path, '/', 1) || '/' || split_part(path, '/', 2) as d, path as was, 0 as lost, '' as keeper from a
 union all select 'dir-' || s, s, null, null, s, case when s in (select s from f) then 1 else 0 end, 'file-' || s from c union all select 'file-' || s, s, null, null, s, 0, '' from f
 union all select 'dir-' || d, case when l = 'en' then d || ' (conflict device-a ' || substr('dir-' || d, 1, 8) || ')' else d end, s, null, d, case when l = 'en' then 1 else 0 end, 'file-' || d from d
 union all select 'file-' || d, d, split_part(d, '/', 1), null, d, 0, '' from g)
, t as (select uuid, was, lost, keeper, case when s in (select s from f) then s || ' (conflict device-a ' || substr('dir-' || s, 1, 8) || ')' || substr(pos, length(s) + 1)
 when d in (select d from g) then d || ' (conflict device-a ' || substr('dir-' || d, 1, 8) || ')' || substr(pos, length(d) + 1)
 when s is null and lost = 1 then pos || ' (conflict device-a ' || substr('dir-' || pos, 1, 8) || ')' else pos end as path from e)
"""


def _nested(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Every first and second folder of a path as a directory entry, and on some of their paths a newer file."""
    part = lambda i: F.split_part(F.col("path"), F.lit("/"), F.lit(i))
    top = fx.a.select(part(1).alias("path"), (F.endswith(part(1), F.lit("3")) | (part(1) == "moved")).alias("taken"))
    second = fx.a.select(F.concat(part(1), F.lit("/"), part(2)).alias("path"), (part(2) == "en").alias("taken"))
    folders = top.union(second).distinct()
    dirs = folders.select(F.concat(F.lit("dir-"), "path").alias("uuid"), F.lit("directory").alias("kind"), "path", F.lit(1_600_000_000_000).alias("updated"), F.lit("device-a").alias("peer"))
    files = folders.filter("taken").select(F.concat(F.lit("file-"), "path").alias("uuid"), F.lit("file").alias("kind"), "path", F.sha2("path", 256).alias("hash"), F.lit(1_800_000_000_000).alias("updated"), F.lit("device-b").alias("peer"))
    return merge.resolve_collisions(merge.entry_rows(fx.a).unionByName(merge.entry_rows(dirs)).unionByName(merge.entry_rows(files)))


@query(_NESTED + "select uuid, path from t")
def path_collisions(fx: Fixtures) -> DataFrame:
    return _nested(fx)[0].select("uuid", "path")


@query(_NESTED + "select uuid, 'kind' as kind, was as path, uuid as copy from t where lost = 1")
def collision_reports(fx: Fixtures) -> DataFrame:
    return _nested(fx)[1].select("uuid", "kind", "path", "copy")


@query(with_tables("base") + "select uuid, path from (select 'conflict:' || case k when 4 then uuid else alt end || ':' || case k when 4 then ha else h0 end as copy, case k when 4 then uuid else alt end as uuid, p as path, k from base where k in (4, 11))")
def pending_conflicts(fx: Fixtures) -> DataFrame:
    return views.pending_conflicts(merged(fx)[0]).select("uuid", "path")


# --- plans ---


_NEEDED = "select '{0}' as pair, count(*) > 0 as needed from {1} x full outer join {2} y on x.uuid = y.uuid where x.uuid is null or y.uuid is null or x.hash is distinct from y.hash"
_SAME = "select '{0}' as pair, coalesce(bool_and(x.uuid is not null and y.uuid is not null and x.path = y.path and x.hash is not distinct from y.hash and x.size = y.size and x.deleted = y.deleted), true) as same from {1} x full outer join {2} y on x.uuid = y.uuid"
_PAIRS = {"a-b": ("a", "b"), "a-a": ("a", "a"), "a-moved": ("a", "m"), "a-less": ("a", "l"), "none": ("n", "n")}
_VARIANTS = with_tables("base", "a", "b") + ", m as (select * replace ('x/' || path as path) from a), l as (select * from a where uuid <> (select min(uuid) from a)), n as (select * from a where false) "


def _variants(fx: Fixtures) -> dict[str, tuple[DataFrame, DataFrame]]:
    """Peer a against b, itself, itself with all paths changed, itself without one entry, and nothing against nothing."""
    a = fx.a
    first = a.agg(F.min("uuid").alias("uuid"))
    side = {"a": a, "b": fx.b, "m": a.withColumn("path", F.concat(F.lit("x/"), "path")), "l": a.join(first, "uuid", "left_anti").select(*a.columns), "n": a.limit(0)}
    return {name: (side[x], side[y]) for name, (x, y) in _PAIRS.items()}


def _each(fx: Fixtures, answer: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    rows = [answer(x, y).select(F.lit(name).alias("pair"), "*") for name, (x, y) in _variants(fx).items()]
    return reduce(lambda x, y: x.unionByName(y), rows)


@query(_VARIANTS + " union all ".join(_NEEDED.format(n, *p) for n, p in _PAIRS.items()))
def needs_log(fx: Fixtures) -> DataFrame:
    return _each(fx, actions.needs_log)


@query(_VARIANTS + " union all ".join(_SAME.format(n, *p) for n, p in _PAIRS.items()))
def same_entries(fx: Fixtures) -> DataFrame:
    return _each(fx, actions.same_entries)


@query("select min(source) as store_id, string_agg(distinct lang, ',' order by lang) as text from documents where source is not null")
def config_converge(fx: Fixtures) -> DataFrame:
    """Every source as a store that reads its own languages as texts."""
    headers = fx.table("documents").filter("source is not null").groupBy(F.col("source").alias("store_id")).agg(F.collect_set("lang").alias("text"))
    return merge.converge_config(headers).select("store_id", F.array_join("text", ",").alias("text"))


_PLAN = EXPECTED.replace("with ", "with ", 1) + ", a as (" + with_tables("a").removeprefix("with a as (").rstrip().removesuffix(")") + """)
, x as (select coalesce(a.uuid, t.uuid) as uuid, a.uuid as ua, t.uuid as ut, a.path as pa, t.path as pt, a.hash as ha, t.hash as ht, coalesce(t.deleted, true) as gone from a full outer join t on a.uuid = t.uuid)
, acts as (select uuid, 'delete' as type, pa as path, false as created from x where ua is not null and gone union all select uuid, 'rename', pt, false from x where ua is not null and not gone and pa <> pt
 union all select uuid, 'write', pt, ua is null from x where not gone and (ua is null or ha is distinct from ht))
"""


@query(_PLAN + "select * from acts")
def plan_actions(fx: Fixtures) -> DataFrame:
    return actions.plan_actions(merge.entry_rows(fx.a), merged(fx)[0], "device-a").select("uuid", "type", "path", "created")


@query(_PLAN + ", b as (" + with_tables("b").removeprefix("with b as (").rstrip().removesuffix(")") + """)
select count(distinct t.hash) as transfers from acts join t on t.uuid = acts.uuid where acts.type = 'write' and t.hash not in (select hash from a where hash is not null) and t.hash in (select hash from b where hash is not null)""")
def plan_transfers(fx: Fixtures) -> DataFrame:
    target = merged(fx)[0]
    acts = actions.plan_actions(merge.entry_rows(fx.a), target, "device-a")
    return actions.count_transfers(target, acts, merge.entry_rows(fx.a), merge.entry_rows(fx.b))


@query(_PLAN + "select case when type = 'write' and not created then 'change' when type = 'write' then 'create' else type end as category, count(*) as n from acts group by 1")
def plan_summary(fx: Fixtures) -> DataFrame:
    return actions.summarize(actions.plan_actions(merge.entry_rows(fx.a), merged(fx)[0], "device-a"))


# --- scanning ---

NOW = 1_900_000_000_000


def _folder(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    """Known: peer a, whose paths of k = 12 have moved to new paths, whose k = 2 is gone, k = 5 edited; k = 1 is new."""
    base = fx.base
    known = merge.entry_rows(fx.a).withColumns({"native": F.lit(None).cast("string"), "mtime": F.col("updated")})
    now = known.join(base.select("uuid", "k", "hm", F.col("p").alias("bp")), "uuid").filter("k <> 2")
    path = F.when(F.col("k") == 12, F.concat(F.lit("new/"), "bp")).otherwise(F.col("path"))
    hash_ = F.when(F.col("k") == 5, F.col("hm")).when(F.col("k") == 12, F.sha2(F.concat(F.lit("own"), "uuid"), 256)).otherwise(F.col("hash"))
    known = known.join(base.select("uuid", "k"), "uuid").withColumn("hash", F.when(F.col("k") == 12, F.sha2(F.concat(F.lit("own"), "uuid"), 256)).otherwise(F.col("hash"))).drop("k")
    files = now.select(path.alias("path"), "kind", hash_.alias("hash"), "size", "mtime", "native")
    new = base.filter("k = 1").select(F.col("p").alias("path"), F.lit("file").alias("kind"), F.sha2(F.concat(F.lit("new"), "uuid"), 256).alias("hash"), F.col("n").alias("size"), F.col("t0").alias("mtime"), F.lit(None).cast("string").alias("native"))
    return files.unionByName(new), known


def _scan(fx: Fixtures) -> tuple[DataFrame, DataFrame]:
    files, known = _folder(fx)
    return snapshot.scan(files, known, "device-a", NOW, new_uuid=lambda p: F.concat(F.lit("new:"), p))


@query(with_tables("base", "a") + f"""select case when k = 1 then 'new:' || p else base.uuid end as uuid, case when k = 12 then 'new/' || p when k = 1 then p else a.path end as path,
 case when k in (1, 2, 5, 12) then {NOW} else a.updated end as updated, k = 2 as deleted, case when k = 5 or k = 2 then a.hash when k = 1 then null else a.prev end as prev, case when k = 12 then a.path else a.prev_path end as prev_path from base left join a on a.uuid = base.uuid""")
def scan_changes(fx: Fixtures) -> DataFrame:
    return _scan(fx)[0].select("uuid", "path", "updated", "deleted", "prev", "prev_path")


@query(with_tables("base", "a") + """select case when k = 1 then 'new:' || p else base.uuid end as uuid, case k when 2 then 'delete' when 12 then 'rename' else 'write' end as type,
 case when k = 12 then 'new/' || p when k = 1 then p else a.path end as path from base left join a on a.uuid = base.uuid where k in (1, 2, 5, 12)""")
def scan_log_rows(fx: Fixtures) -> DataFrame:
    return _scan(fx)[1].select("uuid", "type", "path")


@query(with_tables("base") + f"select uuid, h0 as prev, {NOW} as updated from base where k = 2")
def scan_tombstones(fx: Fixtures) -> DataFrame:
    return _scan(fx)[0].filter("deleted").select("uuid", "prev", "updated")


@query(with_tables("base", "a") + "select base.uuid, 'new/' || p as path, a.path as prev_path from base join a on a.uuid = base.uuid where k = 12")
def rename_by_hash(fx: Fixtures) -> DataFrame:
    return _scan(fx)[1].filter("type = 'rename'").select("uuid", "path", "prev_path")


@query(with_tables("base", "a") + "select path, case when k % 2 = 0 then hash end as hash from a join base on base.uuid = a.uuid")
def reuse_hashes(fx: Fixtures) -> DataFrame:
    a = fx.a.withColumn("mtime", F.col("updated"))
    files = a.join(fx.base.select("uuid", "k"), "uuid").select("path", "size", F.when(F.col("k") % 2 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1).alias("mtime"))
    return snapshot.reuse_hashes(files, a).select("path", "hash")


@query(with_tables("base", "a", "b") + """, s as (select a.uuid, a.path = b.path and a.hash is not distinct from b.hash as same from b left join a on a.uuid = b.uuid)
select b.uuid, case when same then 'n-' || b.uuid end as native from b left join s on s.uuid = b.uuid""")
def adopt(fx: Fixtures) -> DataFrame:
    mine = fx.a.withColumns({"native": F.concat(F.lit("n-"), "uuid"), "mtime": F.col("updated")})
    return snapshot.adopt(fx.b, mine).select("uuid", "native")


# --- views ---


@query(with_tables("base", "a") + """, p as (select path, size, unnest(range(1, len(string_split(path, '/')))) as i from a)
select array_to_string(string_split(path, '/')[1:i], '/') as dir, count(*) as n, cast(sum(size) as bigint) as bytes from p group by 1""")
def dir_rollup(fx: Fixtures) -> DataFrame:
    return views.directory_rollup(fx.a)


@query(with_tables("base", "a") + """, p as (select path, unnest(range(1, len(string_split(path, '/')) + 1)) as i from a), c as (select distinct array_to_string(string_split(path, '/')[1:i], '/') as child from p)
select regexp_extract(child, '^(.*)/[^/]*$', 1) as dir, count(*) as n from c group by 1""")
def child_counts(fx: Fixtures) -> DataFrame:
    return views.child_counts(fx.a)


@query(with_tables("base", "a", "b") + "select a.path, case when b.path is null then 'missing' when b.hash is null then 'unknown' when a.hash = b.hash then 'same' else 'differs' end as state from a left join b on a.path = b.path")
def across_compare(fx: Fixtures) -> DataFrame:
    return views.across(fx.a, fx.b)


@query(with_tables("base", "a", "b") + "select a.path, case when b.path is null then 'untracked' when a.hash = b.hash then 'recorded' else 'modified' end as state from a left join (select * from b where not deleted) b on a.path = b.path")
def tracking_state(fx: Fixtures) -> DataFrame:
    return views.tracking_state(fx.a, fx.b)


@query(with_tables("base", "b") + "select distinct hash from b where not deleted and hash is not null")
def file_hashes(fx: Fixtures) -> DataFrame:
    return views.distinct_hashes(fx.b)


@query(with_tables("base", "a") + """, f as (select doc_id, 'nat-' || base.uuid as native, a.path, a.size, a.updated from a join base on a.uuid = base.uuid)
select distinct path from f where (doc_id % 5 = 0 or doc_id % 7 <> 0) and doc_id % 11 <> 0""")
def change_feed_filter(fx: Fixtures) -> DataFrame:
    e = fx.a.join(fx.base.select("uuid", "doc_id"), "uuid").withColumns({"native": F.concat(F.lit("nat-"), "uuid"), "mtime": F.col("updated")})
    feed = e.select(
        F.when(F.col("doc_id") % 11 == 0, "nowhere").otherwise(F.col("native")).alias("native"), F.lit(None).cast("string").alias("path"), (F.col("doc_id") % 5 == 0).alias("removed"), "size",
        F.when(F.col("doc_id") % 7 == 0, F.col("mtime")).otherwise(F.col("mtime") + 1).alias("mtime"))
    return external_changes(feed, e)


# --- functions ---


@query("""with p as (select page_id, regexp_replace(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/+$', '') as path from pages)
select page_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, regexp_extract(path, '[^/]*$') as name, lower(regexp_extract(path, '(?:^|/)[^/]+\\.([^./]*)$', 1)) as ext, len(string_split(path, '/')) - 1 as depth from p""")
def path_functions(fx: Fixtures) -> DataFrame:
    p = fx.table("pages").select("page_id", paths.normalize(F.regexp_replace("url", r"^https?://|[?#].*$", "")).alias("path"))
    c = F.col("path")
    return p.select("page_id", "path", paths.dirname(c).alias("dir"), paths.basename(c).alias("name"), paths.extension(c).alias("ext"), F.size(paths.ancestors(c)).cast("bigint").alias("depth"))


@query(with_tables("base", "a") + "select uuid, case when path like '%.md' then 'text/markdown' when path like '%.txt' then 'text/plain' else 'application/octet-stream' end as mime, path not like '%.bin' as is_text, case when path like '%.bin' then '📦' else '📄' end as icon from a")
def ext_and_mime(fx: Fixtures) -> DataFrame:
    m = display.mime(F.col("path"))
    return fx.a.select("uuid", m.alias("mime"), display.is_text_mime(m).alias("is_text"), display.icon(m).alias("icon"))


@query("""select l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(l_quantity as bigint) * l_partkey as size, case when size = 1 then '1 byte' when size < 1024 then size || ' bytes' when size < 1048576 then case when size / 1024.0 < 10 then printf('%.1f', floor(size / 1024.0 * 10 + 0.5) / 10) else printf('%.0f', floor(size / 1024.0 + 0.5)) end || ' KB'
 else case when size / 1048576.0 < 10 then printf('%.1f', floor(size / 1048576.0 * 10 + 0.5) / 10) else printf('%.0f', floor(size / 1048576.0 + 0.5)) end || ' MB' end as shown from lineitem""")
def human_sizes(fx: Fixtures) -> DataFrame:
    size = (F.col("l_quantity").cast("bigint") * F.col("l_partkey")).alias("size")
    return fx.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", size).withColumn("shown", display.format_bytes(F.col("size")))


@query("select event_id, case when s < 60 then s || 's ago' when round(s / 60.0) < 60 then cast(round(s / 60.0) as bigint) || 'm ago' when round(round(s / 60.0) / 60) < 24 then cast(round(round(s / 60.0) / 60) as bigint) || 'h ago' else cast(round(round(round(s / 60.0) / 60) / 24) as bigint) || 'd ago' end as shown from (select event_id, greatest(0, cast(floor((1704200000000 - epoch_us(ts) // 1000) / 1000.0 + 0.5) as bigint)) as s from events)")
def human_ages(fx: Fixtures) -> DataFrame:
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return fx.table("events").select("event_id", display.format_ago(at, F.lit(1_704_200_000_000)).alias("shown"))


# --- bytes and texts ---


@query("select doc_id, sha256(unhex(substr(hex(encode(text)), 9, 32))) as part from documents where text is not null")
def byte_ranges(fx: Fixtures) -> DataFrame:
    docs = fx.table("documents").filter("text is not null")
    return docs.select("doc_id", F.sha2(contents.byte_range(F.encode("text", "UTF-8"), 4, 20), 256).alias("part"))


@query("select cast(doc_id as varchar) as path, sha256(text) as sha from documents where text is not null")
def chunk_roundtrip(fx: Fixtures) -> DataFrame:
    files = fx.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "UTF-8").alias("content"))
    back = contents.collect_chunks(contents.chunks(files, 1000))
    return back.select("path", F.sha2("content", 256).alias("sha"))


#: A line is added to the front of one side, and to the end of the other or, for every fourth text, to the front as well.
_EDITS = """with l as (select doc_id, text, (length(text) - length(replace(text, chr(13) || chr(10), ''))) // 2 as crlf, length(text) - length(replace(text, chr(10), '')) as lf from documents where text is not null),
 e as (select *, case when crlf > 0 and crlf < lf then 'eol' when lf = 0 or {clash} then 'block' end as reason, 'A:' || text || ':B' as merged from l)
"""


@query(_EDITS.format(clash="doc_id % 4 = 3") + "select doc_id, reason is null as ok, case when reason is null then sha256(merged) end as sha, reason from e")
def diff3_merge(fx: Fixtures) -> DataFrame:
    docs = fx.table("documents").select("doc_id", "text").filter("text is not null")
    clash = F.col("doc_id") % 4 == 3
    rows = docs.select("doc_id", F.col("text").alias("base"), F.concat(F.lit("A:"), "text").alias("a"), F.when(clash, F.concat(F.lit("B:"), "text")).otherwise(F.concat("text", F.lit(":B"))).alias("b"))
    out = textmerge.merge_text_columns(rows)
    return out.select("doc_id", F.col("merged.ok").alias("ok"), F.sha2("merged.text", 256).alias("sha"), F.col("merged.reason").alias("reason"))


@query(_EDITS.format(clash="false") + "select doc_id, sha256(merged) as hash, octet_length(encode(merged)) as size, 1700000000000 + doc_id * 1000 + 1 as updated, sha256(text || ':B') as prev, sha256('A:' || text) as prev2 from e where reason is null")
def auto_merge_text(fx: Fixtures) -> DataFrame:
    """Every text as the base of a conflict, found through the history of both sides."""
    docs = fx.table("documents").select("doc_id", F.col("doc_id").cast("string").alias("uuid"), "text").filter("text is not null")
    x = docs.select("doc_id", "uuid", "text", F.concat(F.lit("A:"), "text").alias("a"), F.concat("text", F.lit(":B")).alias("b"))
    x = x.withColumns({"base": F.sha2("text", 256), "left_hash": F.sha2("a", 256), "right_hash": F.sha2("b", 256)})
    side = lambda h: x.select("uuid", F.col(h).alias("hash"), F.col("base").alias("prev"), F.lit(None).cast("string").alias("prev2"))
    edges = ancestry.version_edges(side("left_hash").unionByName(side("right_hash")))
    clash = x.select("uuid", F.lit(True).alias("is_text"), F.lit("b").alias("winner"), F.lit(None).cast("string").alias("copy"), F.octet_length("b").alias("larger"), (F.lit(1_700_000_000_000) + F.col("doc_id") * 1000).alias("newest"), "left_hash", "right_hash")
    texts = x.select(F.col("left_hash").alias("hash"), F.col("a").alias("text")).union(x.select("right_hash", "b"))
    merged = textmerge.merge_conflicts(clash, edges, texts, x.select(F.col("base").alias("hash"), "text"), 0, "device-a")
    return merged.select(F.col("uuid").cast("bigint").alias("doc_id"), "hash", "size", "updated", "prev", "prev2")


@query("select cast(doc_id as varchar) as path, text || '!' as content from documents where text is not null and doc_id % 2 = 1 and sha256(text) not in (select sha256(text) from documents where doc_id % 2 = 0 and text is not null) union all select cast(doc_id as varchar), text from documents where text is not null and (doc_id % 2 = 0 or sha256(text) in (select sha256(text) from documents where doc_id % 2 = 0 and text is not null))")
def found_contents(fx: Fixtures) -> DataFrame:
    """Contents by hash from two holders, the first one's where both have it."""
    docs = fx.table("documents").filter("text is not null").withColumn("hash", F.sha2("text", 256))
    first = docs.filter("doc_id % 2 = 0").select("hash", F.col("text").alias("content"))
    second = docs.select("hash", F.concat("text", F.lit("!")).alias("content"))
    return docs.select(F.col("doc_id").cast("string").alias("path"), "hash").join(contents.find_contents(docs, first, second), "hash").select("path", "content")


# --- meshes ---


@query(EXPECTED + f""", d as (select sha256('{{"hash":' || coalesce('"' || hash || '"', 'null') || ',"kind":"file","path":"' || path || '","size":' || size || ',"updated":' || updated || ',"uuid":"' || uuid || '"}}') as op from t where not deleted)
select peer, {_XOR} as state from d, (select unnest(['device-a', 'device-b', 'device-c']) as peer) p group by peer""")
def mesh_converge(fx: Fixtures) -> DataFrame:
    """Three peers in a chain, the third with what is live on the second, until stable: one digest, that of what the scenarios must lead to."""
    log = logset.with_op(fx.log_ab.withColumns({"peer": F.lit("device-c"), "batch": F.lit("b"), "prev_path": F.lit(None).cast("string")}))
    third = fx.b.filter("not deleted")
    peers = {n: PeerState(n, merge.entry_rows(e), log) for n, e in (("device-a", fx.a), ("device-b", fx.b), ("device-c", third))}
    peers, _ = sync_until_stable(peers, chain(list(peers)))
    return fx.spark.createDataFrame([(n, p.digest()) for n, p in peers.items()], "peer string, state string")


def _with_texts(fx: Fixtures) -> tuple[PeerState, PeerState]:
    """Both peers with the texts of all that they have. Entries and log, which a sync reads many times, are worked out from the documents once."""
    log = keep(logset.with_op(fx.log_ab.withColumns({"peer": F.lit("device-c"), "batch": F.lit("b"), "prev_path": F.lit(None).cast("string")})), "log")
    of = lambda peer: fx.held(peer).select("hash", "text").dropDuplicates(["hash"])
    a, b = keep(merge.entry_rows(fx.a), "entries"), keep(merge.entry_rows(fx.b), "entries")
    return PeerState("device-a", a, log, contents=of("a")), PeerState("device-b", b, log, contents=of("b"))


_ARRIVING = EXPECTED + ", a as (" + with_tables("a").removeprefix("with a as (").rstrip().removesuffix(")") + "), b as (" + with_tables("b").removeprefix("with b as (").rstrip().removesuffix(")") + ")\n"
_SIDE = """select '{0}' as side, hash from (select distinct t.hash from t left join {1} x on x.uuid = t.uuid where not t.deleted and (x.uuid is null or x.deleted or x.hash is distinct from t.hash)
 and t.hash not in (select hash from {1} where not deleted and hash is not null) and t.hash in (select hash from {2} where not deleted and hash is not null))"""


@query(_ARRIVING + _SIDE.format("device-a", "a", "b") + " union all " + _SIDE.format("device-b", "b", "a"))
def transferred_contents(fx: Fixtures) -> DataFrame:
    """What a sync appends to the contents of each side: what its planned writes need and it lacks."""
    a, b = _with_texts(fx)
    plan = plan_sync(a, b, SyncOptions(auto_merge=False))
    of = lambda acts, p, other: arriving(plan, acts, p, other).select(F.lit(p.peer).alias("side"), "hash")
    return of(plan.actions_a, a, b).unionByName(of(plan.actions_b, b, a))


@query(with_tables("base", "a") + "select peer, last_sync, false as changed from (select unnest(['device-a', 'device-z']) as peer), (select 5000 as last_sync)")
def quiet_sync(fx: Fixtures) -> DataFrame:
    """Two peers that hold the same: digests say so, and only their marks are new."""
    log = logset.with_op(fx.log_ab.withColumns({"peer": F.lit("device-c"), "batch": F.lit("b"), "prev_path": F.lit(None).cast("string")}))
    a, b = (PeerState(n, merge.entry_rows(fx.a), log) for n in ("device-a", "device-z"))
    a, b, changed = sync(a, b, at_ms=5000)
    return a.peer_marks().unionByName(b.peer_marks()).select("peer", "last_sync", F.lit(changed).alias("changed"))


@query(with_tables("base") + """select 1 as round, case when k in (11) then alt else uuid end as uuid, case when k = 7 then 'location' when k = 9 then 'delete-edit' when doc_id % 32 = 6 then 'location' else 'content' end as kind,
 case when doc_id % 32 = 6 then 'a' else 'b' end as winner from base where k in (4, 7, 9, 11) or doc_id % 32 = 6""")
def mesh_conflicts(fx: Fixtures) -> DataFrame:
    """All conflicts that the edges of a mesh meet until it is stable."""
    log = logset.with_op(fx.log_ab.withColumns({"peer": F.lit("device-c"), "batch": F.lit("b"), "prev_path": F.lit(None).cast("string")}))
    peers = {n: PeerState(n, merge.entry_rows(e), log) for n, e in (("device-a", fx.a), ("device-b", fx.b))}
    return converge(peers, chain(list(peers)))[2].select("round", "uuid", "kind", "winner")


# --- commits, marks and order ---


@query(with_tables("base", "a") + f"""select case when k = 1 then 'new:' || p else base.uuid end as uuid, case k when 2 then 'delete' when 12 then 'rename' else 'write' end as type,
 case when k = 12 then 'new/' || p when k = 1 then p else a.path end as path, {NOW} as at_ms, cast(1 as bigint) as seq, 'b1' as batch from base left join a on a.uuid = base.uuid where k in (1, 2, 5, 12)""")
def commit_changes(fx: Fixtures) -> DataFrame:
    """The log rows that a commit of the scanned folder appends."""
    files, known = _folder(fx)
    state = PeerState("device-a", known, fx.log_ab.limit(0).withColumn("op", F.col("uuid")))
    after, _ = commit(state, files, NOW, "b1", new_uuid=lambda p: F.concat(F.lit("new:"), p))
    return after.log.select("uuid", "type", "path", "at_ms", "seq", "batch")


@query(with_tables("log") + "select op, case when event_id % 3 = 1 then 1 else 0 end as seq from log")
def log_append(fx: Fixtures) -> DataFrame:
    log = fx.log.withColumns({"segment": F.lit(7).cast("bigint"), "seq": F.lit(0).cast("bigint")})
    return logset.append_rows(log.filter("event_id % 3 <> 1"), log.filter("event_id % 3 <> 0"), 7).select("op", F.col("seq").cast("int").alias("seq"))


def _numbered(fx: Fixtures) -> DataFrame:
    return _segmented(fx).withColumn("seq", F.floor(F.col("event_id") / 10).cast("bigint"))


_SEGMENTED = with_tables("log") + ", s as (select *, at_ms // 86400000 as segment, event_id // 10 as seq from log), o as (select max(segment) as segment from s)\n"


@query(_SEGMENTED + "select s.op, s.seq from s join o on o.segment = s.segment where s.seq > 20")
def peer_log_tail(fx: Fixtures) -> DataFrame:
    log = _numbered(fx)
    last = log.agg(F.max("segment")).first()[0]
    return logset.peer_log(log, last, (last, 20)).select("op", "seq")


@query(_SEGMENTED + f"select 'x' as peer, cast(5 as bigint) as last_sync, cast(1 as bigint) as segment, cast(2 as bigint) as seq, 'old' as digest union all select 'y', 1700000000000, any_value(s.segment), max(s.seq), {_XOR} from s join o on o.segment = s.segment")
def peer_marks(fx: Fixtures) -> DataFrame:
    log = _numbered(fx)
    last = log.agg(F.max("segment")).first()[0]
    marks = fx.spark.createDataFrame([("x", 5, 1, 2, "old"), ("y", 6, 3, 4, "older")], MARK)
    return logset.upsert_mark(marks, "y", 1_700_000_000_000, logset.open_mark(log, last))


@query(with_tables("base") + "select min(case when k = 11 then t0 else t0 + 100 end) as since from base where k in (4, 9, 11)")
def coldest_conflict(fx: Fixtures) -> DataFrame:
    return merge.coldest(merged(fx)[1])


@query(with_tables("base", "a") + "select greatest(1700000000500, max(updated) + 1) as at_ms from a")
def scan_stamp(fx: Fixtures) -> DataFrame:
    return snapshot.stamp(fx.a, 1_700_000_000_500)


@query(with_tables("log") + "select op, at_ms, row_number() over (order by at_ms, op) as place from log")
def log_sorted(fx: Fixtures) -> DataFrame:
    return numbered(logset.sort_rows(fx.log).select("op", "at_ms"))


@query(with_tables("log") + "select op, at_ms from log order by at_ms desc, op desc limit 100")
def recent_activity(fx: Fixtures) -> DataFrame:
    return logset.recent(fx.log).select("op", "at_ms")


@query(_PLAN + "select uuid, type, path, row_number() over (order by path, type, uuid) as place from acts")
def actions_sorted(fx: Fixtures) -> DataFrame:
    return numbered(actions.sort_actions(actions.plan_actions(merge.entry_rows(fx.a), merged(fx)[0], "device-a")).select("uuid", "type", "path"))


@query(_PLAN + "select uuid, path, row_number() over (order by length(path) desc, path) as place from acts where type = 'delete'")
def deletes_deepest_first(fx: Fixtures) -> DataFrame:
    return numbered(actions.deepest_first(actions.plan_actions(merge.entry_rows(fx.a), merged(fx)[0], "device-a")).select("uuid", "path"))


@query(with_tables("base", "a") + "select uuid, path, row_number() over (order by kind = 'file', regexp_extract(path, '[^/]*$'), path) as place from a")
def tree_order(fx: Fixtures) -> DataFrame:
    return numbered(views.tree_order(fx.a).select("uuid", "path"))


# --- folders ---


@query(with_tables("base", "a", "b") + """, pa as (select path, unnest(range(1, len(string_split(path, '/')))) as i from a), pb as (select path, unnest(range(1, len(string_split(path, '/')))) as i from b)
, da as (select array_to_string(string_split(path, '/')[1:i], '/') as dir, count(*) as n from pa group by 1), db as (select array_to_string(string_split(path, '/')[1:i], '/') as dir, count(*) as n from pb group by 1)
select da.dir, da.n, db.n as other_n, case when db.n is null then 'missing' when da.n = db.n then 'same' else 'differs' end as state from da left join db on db.dir = da.dir""")
def directory_compare(fx: Fixtures) -> DataFrame:
    return views.compare_directories(fx.a, fx.b)


_FIRST = ", f as (select min(regexp_extract(path, '^(.*)/[^/]*$', 1)) as dir, min(path) as path from a)\n"


@query(with_tables("base", "a") + _FIRST + "select uuid, a.path from a join f on regexp_extract(a.path, '^(.*)/[^/]*$', 1) = f.dir")
def folder_listing(fx: Fixtures) -> DataFrame:
    first = fx.a.agg(F.min(paths.dirname(F.col("path")))).first()[0]
    return list_dir(fx.a, first).select("uuid", "path")


@query(with_tables("base", "a") + _FIRST + "select kind, size, updated as mtime from a join f on a.path = f.path")
def file_stat(fx: Fixtures) -> DataFrame:
    return stat(fx.a.withColumn("mtime", F.col("updated")), fx.a.agg(F.min("path")).first()[0])


@query(with_tables("base", "a") + "select uuid, 'x/y/' || substr(path, 7) as path from a where path like 'moved/%'")
def scoped_paths(fx: Fixtures) -> DataFrame:
    return contents.rerooted(contents.scoped(fx.a, "moved"), "x/y").select("uuid", "path")


@query(with_tables("base", "a") + "select uuid, 'top/' || path as path from a")
def joined_paths(fx: Fixtures) -> DataFrame:
    c = F.col("path")
    return fx.a.select("uuid", paths.join_path(F.lit("/top/./"), paths.dirname(c), F.lit("here/.."), paths.basename(c)).alias("path"))


@query(with_tables("base", "a") + ", f as (select min(path) as p, max(path) as q from a) select uuid, case when path = f.q then f.p else path end as path from a, f where path <> f.p")
def conflict_resolved(fx: Fixtures) -> DataFrame:
    ends = fx.a.agg(F.min("path"), F.max("path")).first()
    return contents.resolve_conflict(fx.a, ends[0], ends[1], "theirs").select("uuid", "path")


@query(with_tables("base", "a") + "select uuid, case when path like 'moved/%' then 'kept/' || path else path end as path from a where path not like 'moved/a/%'")
def folder_edits(fx: Fixtures) -> DataFrame:
    """A folder deleted and its parent renamed."""
    return edits.rename_path(edits.delete_path(fx.a, "moved/a"), "moved", "kept/moved").select("uuid", "path")


@query(with_tables("base", "a") + """select uuid, '{"uuid":"' || uuid || '","kind":"file","path":"' || path || '",' || case when hash is null then '' else '"hash":"' || hash || '",' end || '"size":' || size || ',"created":' || created || ',"updated":' || updated || ',"peer":"' || peer || '"'
 || case when prev is null then '' else ',"prev":"' || prev || '"' end || case when prev_path is null then '' else ',"prevPath":"' || prev_path || '"' end || '}' as value from a""")
def entry_encoding(fx: Fixtures) -> DataFrame:
    return encode_entries(fx.a).select("uuid", "value")


@query(with_tables("base", "a", "b") + """, x as (select * from a where not deleted), y as (select * from b where not deleted)
select coalesce(x.uuid, y.uuid) as uuid, case when y.uuid is null then 'only_a' when x.uuid is null then 'only_b' else 'differs' end as state, x.path as path_a, y.path as path_b from x full outer join y on x.uuid = y.uuid
where x.uuid is null or y.uuid is null or x.path <> y.path or x.hash is distinct from y.hash or x.size <> y.size or x.updated <> y.updated or x.kind <> y.kind""")
def state_difference(fx: Fixtures) -> DataFrame:
    """Two states compared by their trees, from the root down to the entries that differ."""
    a, b = (store_state(e, within(fx.spark, "state").root) for e in (fx.a, fx.b))
    return differing_entries(a, b)


@query(with_tables("log") + "select 'a' as lacks, op, uuid from log where event_id % 997 = 1 union all select 'b', op, uuid from log where event_id % 499 = 2 and event_id % 997 <> 1")
def log_exchange(fx: Fixtures) -> DataFrame:
    """What two logs lack of each other: told by sketches of one size whatever theirs is, and by joins where too much differs."""
    log = fx.log
    a, b = log.filter("event_id % 997 <> 1"), log.filter("event_id % 499 <> 2 or event_id % 997 = 1")
    for_a, for_b, _ = exchanged_rows(a, b)
    mark = lambda rows, side: rows.select(F.lit(side).alias("lacks"), "op", "uuid")
    return mark(for_a, "a").unionByName(mark(for_b, "b"))


@query(with_tables("base") + "select split_part(p, '/', 1) as store, p || '.b' as path, p as origin from base where doc_id % 2 = 1")
def rename_chains(fx: Fixtures) -> DataFrame:
    """Each file renamed twice, and every other one back, in one list a store: what each path was at first."""
    p = F.col("p")
    step = lambda i, a, b: F.struct((F.col("doc_id") + F.lit(i * 1_000_000_000)).alias("seq"), a.alias("from_path"), b.alias("to_path"))
    one, two = F.concat(p, F.lit(".a")), F.concat(p, F.lit(".b"))
    steps = F.filter(F.array(step(0, p, one), step(1, one, two), F.when(F.col("doc_id") % 2 == 0, step(2, two, p))), lambda s: s.isNotNull())
    listed = fx.base.select(F.split_part(p, F.lit("/"), F.lit(1)).alias("store"), F.explode(steps).alias("s")).select("store", "s.*")
    return snapshot.collapse_renames(listed)


@query(with_tables("log") + "select op, uuid, case when event_id % 3 = 1 then 2 else 1 end as version from log")
def raced_appends(fx: Fixtures) -> DataFrame:
    """Two writers that share rows append to one log; the second one began before the first had ended. What each version brought."""
    log = fx.log.select("op", "uuid", "event_id")
    rows = lambda keep: log.filter(keep).select("op", "uuid")
    table = open_table(fx.spark, within(fx.spark, "table").root, "op string, uuid string")
    other = lambda n: table.append(rows("event_id % 3 <> 1"), "op") if n == 1 else None
    table.append(rows("event_id % 3 <> 0"), "op", before_commit=other)
    mark = lambda n: table.read(n, after=n - 1).withColumn("version", F.lit(n))
    return mark(1).unionByName(mark(2))


@query(with_tables("log") + "select op, at_ms // 86400000 as segment from log where at_ms // 86400000 in (select at_ms // 86400000 as s from log group by s having max(at_ms) >= 1704400000000)")
def segment_reads(fx: Fixtures) -> DataFrame:
    """The log stored by segment, and the segments that reach to a moment, whose partitions alone are opened."""
    log = SegmentedLog(fx.spark, within(fx.spark, "segments").root)
    log.append(_segmented(fx).withColumns({"store": F.lit("s"), "seq": F.lit(0).cast("bigint")}))
    return log.since(1_704_400_000_000).select("op", "segment")


@query(with_tables("base", "a", "b") + """, u as (select uuid, path, updated, deleted, 0 as now from a union all select uuid, path, updated, deleted, 1 from b where uuid in (select uuid from b))
select uuid, path, updated, deleted, cast(9 as bigint) as segment from (select *, row_number() over (partition by uuid order by updated desc, now desc) as place from u) where place = 1""")
def rotated_snapshot(fx: Fixtures) -> DataFrame:
    """A segment that has outgrown its limit: the snapshot takes in what is known now, and another segment is open."""
    rows = fx.log_ab.withColumns({"op": F.col("uuid"), "segment": F.lit(5).cast("bigint")})
    snap, segment = rotation.rotate(rows, fx.b, fx.a, 5, 9, 10)
    return snap.select("uuid", "path", "updated", "deleted", F.lit(segment).cast("bigint").alias("segment"))


@query(EXPECTED + ", a as (" + with_tables("a").removeprefix("with a as (").rstrip().removesuffix(")") + """)
select f.*, e.* from (select count(*) as files, cast(sum(size) as bigint) as bytes from a) f, (select count(*) filter (where not deleted) as tracked, count(*) filter (where deleted) as tombstones, count(*) filter (where not deleted and conflict_of is not null) as conflicts from t) e""")
def root_snapshot(fx: Fixtures) -> DataFrame:
    return rotation.root_snapshot(fx.a, merged(fx)[0])


@query(with_tables("base", "a") + """, p as (select distinct array_to_string(string_split(path, '/')[1:i], '/') as path from (select path, unnest(range(1, len(string_split(path, '/')) + 1)) as i from a))
select sha256(path) as id, path from p""")
def resolved_ids(fx: Fixtures) -> DataFrame:
    """Files and folders by ids, parents and names: the path of each."""
    every = fx.a.select(F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("path")).distinct()
    up = paths.dirname(F.col("path"))
    return rotation.resolve_ids(every.select(F.sha2("path", 256).alias("id"), F.when(up != "", F.sha2(up, 256)).alias("parent"), paths.basename(F.col("path")).alias("name")))


@query(EXPECTED + """, c as (select uuid, path, hash, conflict_of from t where uuid = (select min(uuid) from t where conflict_of is not null))
select t.path, case when t.uuid = c.conflict_of then c.hash else t.hash end as hash from t, c where not t.deleted and t.uuid <> c.uuid""")
def pending_resolved(fx: Fixtures) -> DataFrame:
    """Of all pending conflicts, the first settled for the other side's version."""
    entries = keep(merged(fx)[0], "merged")
    first = entries.filter("conflict_of is not null").agg(F.min("uuid")).first()[0]
    files = entries.filter("not deleted").select("path", "kind", "size", "hash")
    return contents.resolve_pending(files, entries, first, "theirs", "device-a").select("path", "hash")


@query(_PLAN + "select case when type = 'write' and not created then 'change' when type = 'write' then 'create' else type end as category, count(*) as n from acts group by 1 union all select 'conflict', count(*) from base where k in (4, 7, 9, 11) or doc_id % 32 = 6")
def preview_groups(fx: Fixtures) -> DataFrame:
    entries, conflicts = merged(fx)
    return actions.preview_groups(actions.plan_actions(merge.entry_rows(fx.a), entries, "device-a"), conflicts)


@query(with_tables("base", "a") + """, p as (select path, unnest(range(1, len(string_split(path, '/')) + 1)) as i from a), c as (select distinct array_to_string(string_split(path, '/')[1:i], '/') as child from p)
select regexp_extract(child, '^(.*)/[^/]*$', 1) as dir, count(*) as n, regexp_extract(child, '^(.*)/[^/]*$', 1) in ('moved', 'src1/en') as is_store from c where contains(child, '/') group by 1""")
def folder_tree(fx: Fixtures) -> DataFrame:
    """Folders with what stands in them, two of which are stores themselves."""
    own = fx.a.select("path").unionByName(fx.spark.sql("select explode(array('moved/.vfs/vfs.json', 'src1/en/.vfs/vfs.json', 'src1/en/.vfs/commits')) as path"))
    return views.folder_tree(own)


# --- stores by adapters ---

_TEXTS = """with d as (select source || '/' || lang || '.txt' as path, doc_id, text from documents where text is not null and source is not null and lang is not null),
 f as (select path, hex(encode(string_agg(text, '' order by doc_id))) as x, cast(sum(octet_length(encode(text))) as bigint) as size from d group by path)
"""


def _stored(fx: Fixtures) -> str:
    """A folder with a file for each source and language, all its texts in order; written through the adapter."""
    docs = fx.table("documents").filter("text is not null and source is not null and lang is not null")
    parts = docs.select(F.concat("source", F.lit("/"), "lang", F.lit(".txt")).alias("path"), F.col("doc_id").alias("start"), F.col("text").cast("binary").alias("content"))
    folder = within(fx.spark, "folder").root
    register_folders(fx.spark)
    write_files(parts, "folder", folder)
    return folder


@query(_TEXTS + """, e as (select path, 'file' as kind, size from f union all select distinct split_part(path, '/', 1), 'directory', 0 from f)
select path, kind, size, row_number() over (order by path) as place from e""")
def walk_order(fx: Fixtures) -> DataFrame:
    """What was written, listed with its directories and in order."""
    return numbered(walk_store(fx.spark, "folder", _stored(fx), directories=True).select("path", "kind", "size"))


_RANGE = 65_536


@query(_TEXTS + f"""select path, i * {_RANGE} as start, least(size, (i + 1) * {_RANGE}) as "end", sha256(unhex(substr(x, cast(2 * i * {_RANGE} + 1 as bigint), {2 * _RANGE}))) as digest
from (select path, x, size, unnest(range(0, greatest(1, cast((size + {_RANGE - 1}) // {_RANGE} as bigint)))) as i from f)""")
def file_ranges(fx: Fixtures) -> DataFrame:
    """Ranges of files, read and hashed apart."""
    found = fx.spark.read.format("folder").option("content", "ranges").option("size", str(_RANGE)).load(_stored(fx))
    return range_digests(found, _RANGE)


@query(_TEXTS + f""", r as (select path, size, i, sha256(unhex(substr(x, cast(2 * i * {_RANGE} + 1 as bigint), {2 * _RANGE}))) as digest
 from (select path, x, size, unnest(range(0, greatest(1, cast((size + {_RANGE - 1}) // {_RANGE} as bigint)))) as i from f))
select path, any_value(size) as size, sha256(string_agg(digest, '' order by i)) as digest from r group by path""")
def file_trees(fx: Fixtures) -> DataFrame:
    """One digest a file from those of its ranges."""
    found = fx.spark.read.format("folder").option("content", "ranges").option("size", str(_RANGE)).load(_stored(fx))
    return tree_digests(range_digests(found, _RANGE))


@query(EXPECTED + "select path, size, hash from t where not deleted")
def applied_folder(fx: Fixtures) -> DataFrame:
    """A folder of all files of one peer, brought to what the merge with another leads to, as it is found afterwards."""
    folder = within(fx.spark, "applied").root
    adapter = FolderAdapter(folder)
    register_folders(fx.spark)
    content = F.encode("text", "UTF-8").alias("content")
    write_files(fx.held("a").select("path", content), "folder", folder)
    with run(fx.spark, "applying"):  # what planning writes goes once the folder is as it should be
        a, b, log = keep(merge.entry_rows(fx.a), "a"), keep(merge.entry_rows(fx.b), "b"), keep(fx.log_ab, "log")
        target = keep(_merged(a, b, log)[0], "target")
        apply_plan(adapter, target, actions.plan_actions(a, target, "device-a"), a, fx.held("b").select("hash", content))
    return file_digests(walk_store(fx.spark, "folder", folder).select("path", "size"), adapter)
