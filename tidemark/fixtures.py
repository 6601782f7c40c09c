"""Peer states and an operation log derived from the driver's tables, in Spark SQL and DuckDB SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_DIALECT = {
    "spark": {"$S": "string", "$H(": "sha2(", "$X)": ", 256)", "$OL": "octet_length(text)", "$MS": "unix_millis(cast(ts as timestamp))"},
    "duckdb": {"$S": "varchar", "$H(": "sha256(", "$X)": ")", "$OL": "octet_length(encode(text))", "$MS": "(epoch_us(ts) // 1000)"},
}

BASE = """select doc_id, cast(doc_id % 16 as int) as k,
 concat('doc-', lpad(cast(doc_id as $S), 8, '0')) as uuid, concat('alt-', lpad(cast(doc_id as $S), 8, '0')) as alt,
 concat(source, '/', lang, '/', cast(doc_id as $S), case doc_id % 3 when 0 then '.md' when 1 then '.txt' else '.bin' end) as p,
 $H(text$X) as h0, $H(concat(text, '#A')$X) as ha, $H(concat(text, '#B')$X) as hb, $H(concat(text, '#M')$X) as hm,
 cast($OL as bigint) as n, 1700000000000 + doc_id * 1000 as t0 from documents where text is not null"""

PEER_A = """select uuid, 'file' as kind,
 case when k in (6, 12) then concat('moved/', p) when k = 7 then concat('moved/a/', p) else p end as path,
 case when k in (3, 4, 9, 15) then ha else h0 end as hash, case when k in (3, 4, 9, 15) then n + 2 else n end as size, t0 as created,
 case when k = 14 then t0 + 500 when k in (3, 4, 6, 7, 9, 12, 15) then t0 + 100 else t0 end as updated, 'device-a' as peer, false as deleted,
 case when k in (3, 4, 9) then h0 when k = 15 then hm end as prev, case when k in (7, 12) or k = 6 and doc_id % 32 <> 6 then p end as prev_path from base where k <> 1"""

PEER_B = """select case when k in (10, 11) then alt else uuid end as uuid, 'file' as kind,
 case when k = 7 then concat('moved/b/', p) else p end as path,
 case when k in (8, 9) then null when k in (4, 5, 11, 12, 14) then hb else h0 end as hash,
 case when k in (8, 9) then 0 when k in (4, 5, 11, 12, 14) then n + 2 else n end as size, t0 as created,
 case when k in (4, 5, 7, 8, 9, 11, 12, 14) then t0 + 200 else t0 end as updated, 'device-b' as peer, k in (8, 9) as deleted,
 case when k in (4, 5, 8, 9, 12, 14) then h0 end as prev, case when k = 7 then p end as prev_path from base where k not in (2, 13)"""

LOG_AB = """select uuid, case when k = 13 then 'delete' else 'write' end as type, t0 + 50 as at_ms, p as path,
 case when k = 15 then hm end as hash, case when k = 15 then h0 end as prev from base where k in (13, 15)"""

LOG = """select $H(concat(peer, '|', uuid, '|', cast(at_ms as $S), '|', type, '|', path, '|', coalesce(hash, ''))$X) as op,
 batch, at_ms, peer, uuid, type, 'file' as kind, path, hash, lag(hash) over (partition by uuid order by at_ms, event_id) as prev, event_id from (
 select event_id, concat('b-', cast(cast(floor(event_id / 10) as bigint) as $S)) as batch, $MS as at_ms,
  case event_id % 3 when 0 then 'device-a' when 1 then 'device-b' else 'device-c' end as peer,
  concat('usr-', cast(user_id as $S), '-', cast(event_id % 4 as $S)) as uuid,
  case event_type when 'error' then 'delete' when 'click' then 'rename' else 'write' end as type,
  concat('u/', cast(user_id as $S), '/', cast(event_id % 7 as $S), '.txt') as path,
  case when event_type = 'error' then null else $H(cast(event_id as $S)$X) end as hash from events) e"""


def render(sql: str, dialect: str) -> str:
    for mark, text in _DIALECT[dialect].items():
        sql = sql.replace(mark, text)
    return sql


def with_tables(*names: str) -> str:
    """The opening of a DuckDB query that names the fixtures: base, a, b, log_ab, log."""
    parts = {"base": BASE, "a": PEER_A, "b": PEER_B, "log_ab": LOG_AB, "log": LOG}
    return "with " + ",\n".join(f"{n} as ({render(parts[n], 'duckdb')})" for n in names) + "\n"


class Fixtures:
    """The same tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _over_base(self, sql: str, base: str = BASE) -> DataFrame:
        return self.spark.sql(f"with base as ({render(base, 'spark').replace('documents', '{documents}')}) {render(sql, 'spark')}", documents=self.table("documents"))

    @property
    def base(self) -> DataFrame:
        return self._over_base("select * from base")

    @property
    def a(self) -> DataFrame:
        return self._over_base(PEER_A)

    @property
    def b(self) -> DataFrame:
        return self._over_base(PEER_B)

    def held(self, peer: str) -> DataFrame:
        """``uuid, path, hash, text`` of a peer's live entries, each text in the row of its entry: no text moves to find its hash."""
        rows = self._over_base({"a": PEER_A, "b": PEER_B}[peer].replace(" from base", ", text, h0, ha, hb, hm from base"), BASE.replace(" from documents", ", text from documents"))
        text = F.coalesce(*(F.when(F.col("hash") == F.col(h), F.concat("text", F.lit(x))) for h, x in (("h0", ""), ("ha", "#A"), ("hb", "#B"), ("hm", "#M"))))
        return rows.filter("not deleted").select("uuid", "path", "hash", text.alias("text"))

    @property
    def log_ab(self) -> DataFrame:
        return self._over_base(LOG_AB)

    @property
    def log(self) -> DataFrame:
        return self.spark.sql(render(LOG, "spark").replace("from events", "from {events}"), events=self.table("events"))
