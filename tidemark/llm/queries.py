"""One query for each training-data operator, over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language, quality
from .chat import fold_conversations, format_chats, loss_text, parse_chats
from .common import table
from .decontaminate import find_contained
from .jaccard import jaccard_groups
from .licenses import PHRASES, TEMPLATES, scan_licenses
from .nearest import nearest
from .pieces import encode_pieces
from .repair import damage, repair_conversations
from .secrets import KINDS, listing, scan_secrets
from .substrings import remove_repeats
from .trie import conversation_paths, prefix_trie
from .warc import through_warc


def _crc(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.train(docs.filter(_crc("doc_id") % 5 != 0))
    found = language.identify(docs, model)
    return found.select("doc_id", (F.coalesce(_crc("doc_id") % 5, F.lit(1)) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(_crc("doc_id") % 4 != 2))
    found = quality.score_quality(docs, model, keep=["doc_id"])
    return found.select("doc_id", (F.coalesce(_crc("doc_id") % 4, F.lit(0)) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
with t as (select 'd' as k, doc_id as id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') as l from documents where text is not null
 union all select 'b', item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') from benchmark where text is not null),
w as (select k, id, len(l) as n, unnest(l) as w, generate_subscripts(l, 1) as i from t where len(l) > 0),
g as (select k, id, n, i, string_agg(w, ' ') over (partition by k, id order by i rows between current row and 4 following) as s from w),
s as (select distinct k, id, s from g where i <= greatest(n - 4, 1)),
n as (select id, count(*) as n from s where k = 'b' group by id)
select doc_id, item_id, n_item, n_common, n_common / n_item as containment from (
 select d.id as doc_id, b.id as item_id, any_value(n.n) as n_item, count(*) as n_common
 from s d join s b on d.s = b.s join n on n.id = b.id where d.k = 'd' and b.k = 'b' group by d.id, b.id)
where n_common * 1000 >= n_item * 750
"""


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base_places", lambda b: b["word"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")  # noqa: E731
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), joined(F.transform("base_places", lambda b: b["label"])).alias("base_labels"),
        joined(F.col("labels")).alias("labels"), F.round("score", 9).alias("score"))  # fmt: skip


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")  # noqa: E731
    base = F.filter("secret_spans", lambda s: s["kind"] < 3)
    return found.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(listing(base), 256).alias("base_sha256"),
        listing(F.col("secret_spans")).alias("spans"), of("random"))  # fmt: skip


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = "<|im_end|><|im_start|>assistant ok"
    own = spark.sql("select -1L as conv_id, t.turn, t.role, {both} as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)".replace("{both}", f"'{both}'"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    read = loss_text(parse_chats(format_chats(fold_conversations(rows))))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))  # fmt: skip


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = _crc("conv_id") % 4
    paths = conversation_paths(table(spark, sf_dir, "conversations"), F.col("conv_id") - F.col("conv_id") % 20, taken)
    return prefix_trie(paths).drop("preorder", "subtree_end")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damage(table(spark, sf_dir, "conversations")))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return through_warc(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
with recursive t as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as l from documents),
w as (select doc_id, len(l) as n, unnest(l) as w, generate_subscripts(l, 1) as i from t),
g as (select doc_id, n, i, string_agg(w, ' ') over (partition by doc_id order by i rows between current row and 4 following) as s from w),
s as (select distinct doc_id, s from g where i <= greatest(n - 4, 1)),
c as (select doc_id, count(*) as n, sha256(string_agg(s, '|' order by s)) as k from s group by doc_id),
r as (select k, min(doc_id) as rep, any_value(n) as n from c group by k),
x as (select r.rep, r.n, s.s from r join s on s.doc_id = r.rep),
e as (select a.rep as a, b.rep as b from x a join x b on a.s = b.s and a.rep < b.rep group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
u as (select a, b from e union all select b, a from e),
p as (select rep as x, rep as y from r union select p.x, u.b from p join u on u.a = p.y),
m as (select x as rep, min(y) as comp from p group by x)
select t.doc_id, coalesce(c.n, 0) as n_shingles, coalesce(m.comp, t.doc_id) as component_id
from t left join c on c.doc_id = t.doc_id left join r on r.k = c.k left join m on m.rep = r.rep
"""

OP7_SQL = r"""
with t as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as l, row_number() over () as r from documents),
v as (select r, i, sha256(array_to_string(l[i:i + 34], ' ')) as h from (select r, l, unnest(range(1, len(l) - 33)) as i from t where len(l) >= 35)),
d as (select h from v group by h having count(*) > 1),
g as (select distinct v.r, v.i + j.j as i from v join d on d.h = v.h, (select unnest(range(0, 35)) as j) j),
w as (select r, doc_id, len(l) as n, unnest(l) as w, generate_subscripts(l, 1) as i from t),
k as (select w.r, count(g.i) as gone, string_agg(w.w, ' ' order by w.i) filter (where g.i is null) as kept from w left join g on g.r = w.r and g.i = w.i group by w.r)
select t.doc_id, len(t.l) as n_words, coalesce(k.gone, 0) as n_removed, sha256(coalesce(k.kept, '')) as kept_sha256 from t left join k on k.r = t.r
"""


def _op8_sql() -> str:
    """The whole rule, without an index: every template at every place of every file."""
    phrases = ", ".join(f"('{p}', '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', '{key}', '{body}')" for i, (label, key, body) in enumerate(TEMPLATES))
    return rf"""
with t as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as l from documents),
f as (select doc_id, l, ' ' || array_to_string(l, ' ') || ' ' as body from t),
ph as (select string_split(p, ' ') as p, label from (values {phrases}) as v(p, label)),
tp as (select * from (values {templates}) as v(tid, label, key, body)),
tw as (select tid, w, min(i) - 1 as pos from (select tid, unnest(string_split(body, ' ')) as w, generate_subscripts(string_split(body, ' '), 1) as i from tp) group by tid, w),
fw as (select doc_id, unnest(l) as w, generate_subscripts(l, 1) - 1 as pos from f),
df as (select w, count(distinct doc_id) as df from fw where w in (select w from tw) group by w),
idf as (select v.w, ln(1 + (1 + (select count(*) from t)) / (1 + coalesce(df.df, 0))) as idf from (select distinct w from tw) v left join df on df.w = v.w),
whole as (select tid, sum(idf) as total from tw join idf on idf.w = tw.w group by tid),
cand as (select fw.doc_id, tw.tid, fw.pos - tw.pos as off, sum(idf.idf) as held from fw join tw on tw.w = fw.w join idf on idf.w = tw.w group by all),
m as (select c.doc_id, tp.label, least(c.held / whole.total, 1.0) as score from cand c join whole on whole.tid = c.tid join tp on tp.tid = c.tid join f on f.doc_id = c.doc_id
 where c.held / whole.total >= 0.6 and contains(f.body, ' ' || tp.key || ' ')),
b as (select f.doc_id, ph.label, i - 1 as pos from f, ph, (select unnest(range(1, (select coalesce(max(len(l)), 1) + 1 from t))) as i) i
 where contains(f.body, ' ' || array_to_string(ph.p, ' ') || ' ') and i <= len(f.l) - len(ph.p) + 1 and f.l[i:i + len(ph.p) - 1] = ph.p),
bs as (select doc_id, count(*) as n, min(pos) as first, max(pos) as last, string_agg(distinct label, ',' order by label) as labels from b group by doc_id),
al as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from b union all select doc_id, label from m) group by doc_id),
ms as (select doc_id, max(score) as score from m group by doc_id)
select f.doc_id, len(f.l) as n_words, coalesce(bs.n, 0) as n_base, bs.first as first_word, bs.last as last_word, coalesce(bs.labels, '') as base_labels, coalesce(al.labels, '') as labels,
 case when bs.n > 0 then 1.0 else round(coalesce(ms.score, 0.0), 9) end::double as score
from f left join bs on bs.doc_id = f.doc_id left join al on al.doc_id = f.doc_id left join ms on ms.doc_id = f.doc_id
"""


OP8_SQL = _op8_sql()

OP10_SQL = r"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
 union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
 union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
o as (select *, length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\', '\\'), chr(10), '\n'))
 + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) + 24 as chars from r)
select conv_id, count(*) as n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum(chars) as bigint) as formatted_chars
from o group by conv_id
"""

def crc_sql(text: str) -> str:
    """CRC-32 of an ASCII string, bit by bit."""
    bit = "case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: cast(ascii(substr({text}, i, 1)) as bigint))"
    return f"xor(list_reduce({codes}, lambda c, b: list_reduce(range(8), lambda v, k: {bit}, xor(c, b)), 4294967295), 4294967295)"


OP11_SQL = r"""
with c as (select conv_id, turn, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as d, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as words from conversations where conv_id is not null),
r as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, d) - 1 as pos, d, words from c),
i as (select conv_id, conv_id - conv_id % 20 as base, $CRC % 4 as h from (select distinct conv_id, cast(conv_id as varchar) as s from c)),
t as (select i.conv_id, r.pos, r.d, r.words from i join r on r.conv_id = i.base where r.pos < i.h union all select i.conv_id, r.pos, r.d, r.words from i join r on r.conv_id = i.conv_id where r.pos >= i.h),
s as (select conv_id, row_number() over (partition by conv_id order by pos) as depth, words, string_agg(d, '') over (partition by conv_id order by pos rows between unbounded preceding and current row) as k from t),
m as (select conv_id, 0 as depth, '' as k, 0 as words from i union all select conv_id, depth, k, words from s),
n as (select k, any_value(depth) as depth, any_value(words) as words, min(conv_id) as conv_id, count(*) as n from m group by k),
kids as (select substr(k, 1, 64 * (depth - 1)) as k, count(*) as n from n where depth > 0 group by 1),
x as (select n.n, n.words, kids.k is null as leaf, n.k, unnest(range(0, n.depth + 1)) as a from n left join kids on kids.k = n.k),
u as (select substr(k, 1, 64 * a) as k, sum(case when leaf then 1 else 0 end) as leaves, sum((n - 1) * words) as saved from x group by 1),
l as (select conv_id, max(depth) as depth from m group by conv_id),
e as (select m.k, sha256(string_agg(cast(m.conv_id as varchar), ',' order by m.conv_id)) as h from m join l on l.conv_id = m.conv_id and l.depth = m.depth group by m.k)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(kids.n, 0) as n_children, cast(u.leaves as bigint) as n_leaves, cast(u.saved as bigint) as saved_tokens, coalesce(e.h, sha256('')) as ends_sha256
from n join u on u.k = n.k left join kids on kids.k = n.k left join e on e.k = n.k left join n p on n.depth > 0 and p.k = substr(n.k, 1, 64 * (n.depth - 1))
""".replace("$CRC", crc_sql("s"))

def _op12_sql() -> str:
    """Least cost and audit from each place on and in each state, folded over a signature from its end."""
    step = lambda cost, letter, to: f"{{'c': b[{to}].c + {cost}, 'a': '{letter}' || b[{to}].a}}"  # noqa: E731
    made = [3, 3, 4, 3]  # the state, from 1, that an inserted or rerolled row leads to
    relax = lambda b: "list_reduce(range(3), lambda b, k: [" + ", ".join(f"least(b[{i + 1}], {step(2, 'I', made[i])})" for i in range(4)) + f"], {b})"  # noqa: E731
    extra, never = "case when x = upper(x) then 1 else 0 end", "case when {} then 0 else 1000000 end"
    keep = lambda to, role: step(f"{extra} + " + never.format(f"lower(x) = '{role}'"), "K", to)  # noqa: E731
    kept = [[keep(2, "s"), keep(3, "u")], [keep(3, "u")], [keep(4, "a")], [keep(3, "u")]]
    reroled = lambda i: step(f"2 + {extra} + " + never.format("x <> '-'"), "R", made[i])  # noqa: E731
    edits = "[" + ", ".join("list_min([" + ", ".join([step(3, "D", i + 1), *kept[i], reroled(i)]) + "])" for i in range(4)) + "]"
    end = "[{'c': 0, 'a': ''}, {'c': 1000000, 'a': ''}, {'c': 1000000, 'a': ''}, {'c': 0, 'a': ''}]"
    solved = f"list_reduce(list_reverse(string_split(sig, '')), lambda b, x: {relax(edits)}, {relax(end)})[1]"
    return rf"""
with o as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as s from conversations),
f as (select *, {crc_sql("s")} % 20 as fate, sha256(length(role) || ':' || role || text) as tie from o),
d as (select conv_id, turn, tie, unnest(range(0, case when fate = 3 then 2 else 1 end)) as copy, case when fate = 4 then 'user' else role end as role,
 case when fate = 1 then '' when fate = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text from f where fate <> 0),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, tie, copy) as place, row_number() over (partition by conv_id, role, text order by turn nulls first, tie, copy) as nth,
 case when substr(role, 1, 1) in ('s', 'u', 'a') then substr(role, 1, 1) else 'x' end as ini, not regexp_matches(text, '[^ 	-]') as blank,
 regexp_matches(text, '[^.!? 	-][ 	-]*\z') as cut from d),
q as (select *, case when blank then 'blank' when nth > 1 then 'duplicate' when cut then 'truncated' end as fault, lag(ini) over (partition by conv_id order by place) as was from p),
g as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
 count(*) filter (where was is not null and was || ini not in ('su', 'ua', 'au')) as illegal, string_agg(case when fault in ('blank', 'duplicate') then '-' when fault = 'truncated' then upper(ini) else ini end, '' order by place) as sig from q group by conv_id),
v as (select sig, {solved} as r from (select distinct sig from g)),
a as (select g.*, v.r.c as cost, v.r.a as audit from g join v on v.sig = g.sig),
l as (select conv_id, substr(audit, i, 1) as letter, i from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as i from a)),
e as (select conv_id, letter, sum(case when letter <> 'I' then 1 else 0 end) over w as place, sum(case when letter <> 'D' then 1 else 0 end) over w as o from l window w as (partition by conv_id order by i rows between unbounded preceding and current row)),
h as (select e.conv_id, e.letter, e.o, q.role, case when e.letter = 'I' then '' else q.text end as text, coalesce(max(case when e.o = 1 and e.letter = 'K' and q.ini = 's' then 1 else 0 end) over (partition by e.conv_id), 0) as sys
 from e left join q on q.conv_id is not distinct from e.conv_id and q.place = e.place where e.letter <> 'D'),
r as (select conv_id, sha256(string_agg(case when letter = 'K' then role when (o - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by o)) as sha from h group by conv_id)
select c.conv_id, coalesce(a.gaps, 0) as gaps, coalesce(a.blank, 0) as blank, coalesce(a.duplicate, 0) as duplicate, coalesce(a.truncated, 0) as truncated, coalesce(a.illegal, 0) as illegal,
 coalesce(cast(a.cost as bigint), 0) as cost, coalesce(a.audit, '') as audit, coalesce(r.sha, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) c left join a on a.conv_id is not distinct from c.conv_id left join r on r.conv_id is not distinct from c.conv_id
"""


OP12_SQL = _op12_sql()

OP13_SQL = r"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h, row_number() over (order by page_id) as r from pages),
v as (select *, list_transform(range(8), lambda i: cast('0x' || substr(h, cast(5 * i + 1 as bigint), 5) as bigint)) as v from p),
d as (select *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((v[i // 4 + 1] >> (15 - 5 * (i % 4))) & 31) + 1 as bigint), 1)), '') as payload_digest,
 min(r) over (partition by h, payload_bytes) as first_r, min(page_id) over (partition by h, payload_bytes) as first_id from v)
select page_id, payload_bytes, payload_digest, case when r = first_r then 'response' else 'revisit' end as record_type, case when r <> first_r then first_id end as refers_to from d
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language": op1_language,
    "op2_nearest": op2_nearest,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_jaccard": op5_jaccard,
    "op6_pieces": op6_pieces,
    "op7_substrings": op7_substrings,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_chat": op10_chat,
    "op11_trie": op11_trie,
    "op12_repair": op12_repair,
    "op13_warc": op13_warc,
}

#: Learned models, an approximate search, a tokenizer and randomness tests are beyond SQL; tests/llm holds them against plain versions.
ORACLE_SQL: dict[str, str] = {"op3_decontaminate": OP3_SQL, "op5_jaccard": OP5_SQL, "op7_substrings": OP7_SQL, "op8_licenses": OP8_SQL, "op10_chat": OP10_SQL, "op11_trie": OP11_SQL, "op12_repair": OP12_SQL, "op13_warc": OP13_SQL}
