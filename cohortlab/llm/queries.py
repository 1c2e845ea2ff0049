"""The corpus operators bound to whole tables, one query each, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, fingerprints, html_text, licences, line_templates, near_dup, packing, periodic_runs, sharding, suffix_tree, token_files, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]

#: pieces that a worker remembers of the queries that do nothing else with its memory
PIECES = 1_200_000


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; any path can be given to the operators instead."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_templates.drop_recurring_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("clean_md5"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = licences.scan_licences(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.array_join("sentences", " ").alias("sentences"), F.array_join("licences", ", ").alias("licences"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), length=2048, memory=PIECES)


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.suffix_tree_scores(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), memory=PIECES)


def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine_collocations(table(spark, sf_dir, "documents"), top=2000)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(periodic_runs.with_planted_periods(table(spark, sf_dir, "documents")))
    best = found.withColumn("best", periodic_runs.strongest("runs"))
    told = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    run = ("start", "length", "period")
    return best.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *(F.col(f"best.{c}").alias(c) for c in run), F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(told, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Query]:
    found = [op1_line_dedup, op2_near_dup, op3_toxicity, op4_fingerprints, op5_licences, op6_packing, op7_lm_scores, op8_decontamination, op9_html_text, op10_token_files, op11_kd_shards, op12_collocations, op13_periodic_runs]
    return {f.__name__: f for f in found}


LINE_DEDUP_SQL = """
with lines as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line from documents
), flat as (
  select doc_id, pos, trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g')) as exact from lines
), tried as (
  select doc_id, pos, string_split(exact, ' ') as plain, string_split(regexp_replace(exact, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') as m from flat where exact != ''
), held as (
  select doc_id, pos, array_to_string(tokens, ' ') as th, len(tokens) as n, case when len(tokens) > 3 then concat_ws(' ', len(tokens), tokens[1], tokens[2], tokens[3]) end as leaf, tokens from (
    select doc_id, pos, case when len(m) > 3 and len(list_filter(m, lambda x: x != '<*>')) >= 0.7 * len(m) and len(list_filter(m[4:], lambda x: x != '<*>')) >= 0.5 * (len(m) - 3) then m else plain end as tokens from tried
  ) where len(tokens) >= 2
), masked as (
  select th, any_value(leaf) as leaf, any_value(n) as n, any_value(tokens) as tokens, count(distinct doc_id) as docs from held group by th
), leaves as (
  select leaf from masked where leaf is not null group by leaf having count(*) > 1 and sum(docs) >= 5
), fields as (
  select th, leaf, n, docs, len(list_filter(tokens[:3], lambda x: x != '<*>')) as led, generate_subscripts(tokens[4:], 1) as fld, unnest(tokens[4:]) as token from masked join leaves using (leaf)
), agreed as (
  select leaf, fld, token from fields where token != '<*>' group by leaf, fld, token having sum(docs) >= 5
), marked as (
  select f.th, f.leaf, f.n, f.led, f.fld, a.token as kept
  from fields f left join agreed a on a.leaf = f.leaf and a.fld = f.fld and a.token = f.token
), general as (
  select th, concat(leaf, ' ', string_agg(coalesce(kept, '<*>'), ' ' order by fld)) as template from marked group by th, leaf, n, led having count(kept) + led >= 0.7 * n and count(kept) >= 0.5 * (n - 3)
), named as (
  select doc_id, pos, case when g.th is null then 'own ' || h.th else 'all ' || g.template end as template from held h left join general g on g.th = h.th
), recurring as (
  select template, min(doc_id * 1000000 + pos) as first from named group by template having count(distinct doc_id) >= 5
), gone as (
  select doc_id, pos from named join recurring using (template) where doc_id * 1000000 + pos != first
)
select l.doc_id, count(*) as n_lines, count(g.pos) as n_dropped,
       md5(coalesce(string_agg(case when g.pos is null then l.line end, chr(10) order by l.pos), '')) as clean_md5
from lines l left join gone g on g.doc_id = l.doc_id and g.pos = l.pos group by l.doc_id
"""

NEAR_DUP_SQL = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != '') as w from documents
), sets as (
  select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end)) as s from words
), size as (
  select doc_id, count(*) as n from sets group by doc_id
), hashed as (
  select doc_id, n, hash(s) as h from sets join size using (doc_id)
), pairs as (
  select x.doc_id as a, y.doc_id as b, x.n + y.n as total, count(*) as common from hashed x join hashed y on x.h = y.h and x.doc_id < y.doc_id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  group by x.doc_id, y.doc_id, x.n, y.n
), links as (
  select a, b from pairs where 100 * common >= 80 * (total - common)
), edges as (
  select a as u, b as v from links union select b, a from links
), reach as (
  select doc_id as u, doc_id as v from documents union select r.u, e.v from reach r join edges e on e.u = r.v
), comp as (
  select u as doc_id, min(v) as component_id from reach group by u
)
select d.doc_id, coalesce(s.n, 0) as n_shingles, c.component_id, d.doc_id = c.component_id as kept from documents d join comp c using (doc_id) left join size s using (doc_id)
"""


#: the steps of CRC-32 for each value of a byte, by its polynomial
CRC_TABLE = """crc(n, k, c) as (
  select n, 0, n from range(256) t(n) union all select n, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from crc where k < 8
), tab as (
  select list(c order by n) as t from crc where k = 8
)"""


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)), lambda a, b: xor(a // 256, t[xor(a % 256, b) + 1])), 4294967295)"


def _shard_sql() -> str:
    steps = []
    for level in range(3):
        wide = ", ".join(f"(max(x{i}) over n - min(x{i}) over n) / (select greatest(max(x{i}) - min(x{i}), 1) from atoms) as d{i}" for i in range(3))
        steps.append(f"""wide{level} as (
  select *, {wide}, sum(w) over n as whole from node{level} window n as (partition by node)
), sum{level} as (
  select *, sum(w) over (partition by node order by c, tie rows unbounded preceding) as upto from (
    select *, case when d0 >= d1 and d0 >= d2 then x0 when d1 >= d2 then x1 else x2 end as c from wide{level})
), cut{level} as (
  select node, arg_min(c, upto) as value, arg_min(tie, upto) as edge, arg_min(2 * (upto - w) + w <= whole, upto) as last from sum{level} where 2 * upto >= whole group by node
), node{level + 1} as (
  select key, w, x0, x1, x2, tie, 2 * s.node + case when c < value or (c = value and (tie < edge or (last and tie = edge))) then 0 else 1 end as node from sum{level} s join cut{level} using (node)
)""")
    code = lambda c: f"coalesce(('0x' || rpad(hex(encode({c}))[:14], 14, '0'))::bigint, 0)"
    return f"""
with recursive {CRC_TABLE}, rows as (
  select doc_id, md5(coalesce(text, '')) as digest, strlen(coalesce(text, '')) + 1 as size, floor(sqrt((strlen(coalesce(text, '')) + 1)::double) * 1000)::bigint as x0, {code('source')} as x1, {code('lang')} as x2,
         {_crc("coalesce(text, '')")} as crc
  from documents, tab
), heavy as (
  select digest from rows group by digest having sum(size) > (select sum(size) from rows) // 1600
), keyed as (
  select *, case when digest in (select digest from heavy) then md5(digest || ':' || coalesce(doc_id::varchar, '')) else digest end as key from rows
), atoms as (
  select key, sum(size)::bigint as w, min(x0) as x0, min(x1) as x1, min(x2) as x2, ('0x' || key[:15])::bigint as tie from keyed group by key
), node0 as (
  select *, 0 as node from atoms
), {", ".join(steps)}
select doc_id, size::bigint as size, crc as text_crc32, 'bytes' as law, node::int as shard,
       row_number() over (partition by node order by ('0x' || md5(coalesce(doc_id::varchar, '') || ':' || digest)[:15])::bigint, doc_id, digest) - 1 as slot, null::int as grown_shard
from keyed join node3 using (key)
"""


COLLOCATION_SQL = """
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\f\\r]')) as piece from documents
), words as (
  select lang, list_filter(regexp_split_to_array(piece, '[ \\t]+'), lambda x: x != '') as w from pieces
), held as (
  select lang, w, len(w) as m from words where len(w) > 0
), one as (
  select lang, x, count(*) as f from (select lang, unnest(w) as x from held) group by lang, x
), size as (
  select lang, sum(f)::bigint as n from one group by lang
), two as (
  select lang, x, y, count(*) as f from (select lang, unnest(w[1:m-1]) as x, unnest(w[2:m]) as y from held where m >= 2) group by lang, x, y having count(*) >= 10
), three as (
  select lang, x, y, z, count(*) as f from (select lang, unnest(w[1:m-2]) as x, unnest(w[2:m-1]) as y, unnest(w[3:m]) as z from held where m >= 3) group by lang, x, y, z having count(*) >= 10
), scored2 as (
  select t.lang, t.x, t.y, t.x || ' ' || t.y as phrase, t.f as a, p.f as l, q.f as r, (1000000::hugeint * t.f * t.f // (p.f::hugeint * q.f))::bigint as score
  from two t join one p on p.lang = t.lang and p.x = t.x join one q on q.lang = t.lang and q.x = t.y
), scored3 as (
  select *, (1000000::hugeint * a * a // (l1::hugeint * r1))::bigint as s1, (1000000::hugeint * a * a // (l2::hugeint * r2))::bigint as s2 from (
    select t.lang, t.x || ' ' || t.y || ' ' || t.z as phrase, t.f as a, p.f as l1, yz.f as r1, xy.f as l2, q.f as r2
    from three t join one p on p.lang = t.lang and p.x = t.x join one q on q.lang = t.lang and q.x = t.z
    join two xy on xy.lang = t.lang and xy.x = t.x and xy.y = t.y join two yz on yz.lang = t.lang and yz.x = t.y and yz.y = t.z)
), inside as (
  select lang, x, y, max(f) as longer from (select lang, x, y, f from three union all select lang, y, z, f from three) group by lang, x, y
), alive as (
  select s.lang, phrase, a, l, r, score from scored2 s left join inside i on i.lang = s.lang and i.x = s.x and i.y = s.y where longer is null or 100 * longer < 50 * a
  union all
  select lang, phrase, a, case when s1 <= s2 then l1 else l2 end, case when s1 <= s2 then r1 else r2 end, least(s1, s2) from scored3
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from alive
)
select k.lang, rank, phrase, a, l, r, n, score from ranked k join size using (lang) where rank <= 2000
"""

RUNS_SQL = f"""
with recursive {CRC_TABLE}, texts as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x != '') as w, {_crc("doc_id::varchar")} as h from documents, tab
), sized as (
  select doc_id, w, len(w) as n, h, h // 10 as g from texts
), placed as (
  select *, g % n as a, 1 + (n - g % n) // (3 + g % 8) as p from sized where n > 0
), planted as materialized (
  select doc_id, n, case when h % 10 = 0 then list_transform(range(0, n), lambda i: case when i < a then w[i + 1] else w[a + (i - a) % p + 1] end) else w end as w from placed
), words as materialized (
  select doc_id, unnest(range(0, n)) as i, unnest(w) as x from planted
), followed as materialized (
  select doc_id, i, w[i + 1] as x, hash(w[i + 1:i + 8]) as y from (select doc_id, w, unnest(range(0, n)) as i from planted)
), grid as (
  select doc_id, q, unnest(range(0, (n - 1) // q - 1)) as k from (select doc_id, n, unnest(range(1, n // 3 + 1)) as q from planted where n >= 24)
), tried as materialized (
  select distinct g.doc_id, g.q from grid g join followed a on a.doc_id = g.doc_id and a.i = g.k * g.q join followed b on b.doc_id = g.doc_id and b.i = (g.k + 1) * g.q and b.x = a.x and b.y = a.y join words c on c.doc_id = g.doc_id and c.i = (g.k + 2) * g.q and c.x = a.x
), alike as (
  select t.doc_id, t.q, a.i, a.i - row_number() over (partition by t.doc_id, t.q order by a.i) as island from tried t join words a on a.doc_id = t.doc_id join words b on b.doc_id = t.doc_id and b.i = a.i + t.q and b.x = a.x
), stretches as (
  select doc_id, q, min(i) as start, count(*) + q as length from alike group by doc_id, q, island having count(*) + q >= greatest(24, 3 * q)
), runs as materialized (
  select doc_id, start, length, min(q) as period from stretches group by doc_id, start, length
), told as (
  select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as t from runs group by doc_id
), best as (
  select * from runs qualify row_number() over (partition by doc_id order by length::double / period desc, start, period) = 1
), kept as (
  select doc_id, string_agg(x, ' ' order by i) as t from words s where not exists (select 1 from runs r where r.doc_id = s.doc_id and s.i >= r.start + r.period and s.i < r.start + r.length) group by doc_id
)
select d.doc_id, coalesce(t.n_runs, 0) as n_runs, b.start, b.length, b.period, 1000 * b.length // b.period as exponent_milli, sha256(coalesce(t.t, '')) as runs_sha256, sha256(coalesce(k.t, '')) as collapsed_sha256
from documents d left join told t using (doc_id) left join best b using (doc_id) left join kept k using (doc_id)
"""


def _licence_sql() -> str:
    hint = "|".join(licences.HINTS)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    pairs = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licences.SENTENCES.items())
    order = "[" + ", ".join(quoted(x) for x in dict.fromkeys(r[1] for r in licences.RULES)) + "]"
    norm = "trim(regexp_replace(regexp_replace(lower(s), '[^a-z0-9.]+', ' ', 'g'), '(^| )\\.+|\\.+( |$)', ' ', 'g'))"
    for pattern, alike in licences.HOLDERS:
        norm = f"regexp_replace({norm}, {quoted(pattern)}, {quoted(alike)})"
    steps = ["rules0 as (select doc_id, way, ids, ' ' || array_to_string(ids, '  ') || ' ' as rest, []::varchar[] as found from seqs)"]
    for i, (sequence, licence) in enumerate(licences.RULES):
        wanted, rest = quoted(licences.pattern(sequence).replace("\\-", "-")), quoted("".join(f"\\{n}" for n in range(1, len(sequence))))
        steps.append(f"rules{i + 1} as (select doc_id, way, ids, regexp_replace(rest, {wanted}, {rest}, 'g') as rest, case when regexp_matches(rest, {wanted}) then list_append(found, {quoted(licence)}) else found end as found from rules{i})")
    cuts = " union all ".join(f"select doc_id, {way} as way, regexp_split_to_array(regexp_replace(text, {quoted(licences.TAG)}, 'SPDX-License-Identifier ', 'g'), {quoted(ends)}) as parts from documents where regexp_matches(lower(text), {quoted(hint)})" for way, ends in ((1, licences.LINE_ENDS), (2, licences.ENDS)))
    return f"""
with known as (select * from (values {pairs}) as t(sentence, id)),
cut as ({cuts}), parts as (
  select doc_id, way, generate_subscripts(parts, 1) as pos, unnest(parts) as s from cut
), seqs as (
  select p.doc_id, p.way, coalesce(list(k.id order by p.pos) filter (where k.id is not null), []) as ids from parts p left join known k on k.sentence = {norm.replace("(s)", "(p.s)")} group by p.doc_id, p.way
), {", ".join(steps)},
best as (
  select a.doc_id, case when len(a.ids) >= len(b.ids) then a.ids else b.ids end as ids, list_concat(a.found, b.found) as found
  from rules{len(licences.RULES)} a join rules{len(licences.RULES)} b on a.doc_id = b.doc_id and a.way = 1 and b.way = 2
)
select d.doc_id, coalesce(array_to_string(b.ids, ' '), '') as sentences,
       coalesce(array_to_string(list_filter({order}, lambda x: list_contains(b.found, x)), ', '), '') as licences
from documents d left join best b using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP_SQL, "op2_near_dup": NEAR_DUP_SQL, "op5_licences": _licence_sql(), "op11_kd_shards": _shard_sql(), "op12_collocations": COLLOCATION_SQL, "op13_periodic_runs": RUNS_SQL}
