"""The subpackage's queries for __spark_entry__.py, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, codes, decontaminate, dialogue, fingerprint, html_extract, language, ngram_join, pieces, pii, secrets, topk, toxicity
from .scratch import table


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The conversation that the query adds to the table: control strings inside texts.
TRAP = "\\### Assistant: </turn> ok"


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.createDataFrame([(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted_pieces(turns.unionByName(trap)))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmentations(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(table(spark, sf_dir, "pages"))


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest(table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.repaired(dialogue.damaged(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [x for name, x in globals().items() if name.startswith("op") and callable(x)]
    return {x.__name__: x for x in found}


_TURNS = f"(select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all values (-7, 0, 'user', '{TRAP}'), (-7, 1, 'assistant', '{TRAP}'))"
_WORDS = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_CELLS = "select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as cells from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _assigned(name: str, k: int) -> str:
    """The nearest entry of every part, of the codebooks b<k>."""
    distance = "list_sum(list_transform(list_zip(x, e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    return f"{name}{k} as (select vec_id, any_value(label) as label, part, any_value(x) as x, min(struct_pack(d := dist, n := entry)).n as entry, min(dist) as dist from (select p.*, entry, {distance} as dist from p join b{k} using (part)) group by vec_id, part)"


def _lloyd(k: int) -> str:
    """A round: parts are assigned to the codebooks b<k>, and entries move to b<k + 1>."""
    means = f"select part, entry, place, floor(sum(x[place]) / count(*)) as mean from a{k}, w, range(1, d + 1) as r(place) group by all"
    return f"{_assigned('a', k)}, m{k} as (select part, entry, list(mean order by place) as e from ({means}) group by all), b{k + 1} as (select part, entry, coalesce(m{k}.e, b{k}.e) as e from b{k} left join m{k} using (part, entry))"


def _step(cost: int, audit: str, said: str) -> str:
    """What it costs to go, by which edits, and what is then said, each line with a line feed before it."""
    return f"struct_pack(c := {cost}::bigint, a := '{audit}', t := '{''.join(chr(10) + x for x in said.split())}')"


def _edit(cost: str | int, letter: str, said: str, after: str) -> str:
    return f"struct_pack(c := ({cost} + {after}.c)::bigint, a := '{letter}' || {after}.a, t := {said} || {after}.t)"


def _insert(role: str, after: str) -> str:
    return _edit(2, "I", f"chr(10) || '{role}:'", after)


def _choices(k: int) -> str:
    """Of what can become of a turn in the kth state, the cheapest and then ASCII-least."""
    due, to = (("a", 4) if k == 3 else ("u", 3))
    extra, line = "case fault when 'truncated' then 1 else 0 end", "chr(10) || role || ':' || text"
    kept = f"case when own = '{due}' then {_edit(extra, 'K', line, f's[{to}]')}" + (f" when own = 's' then {_edit(extra, 'K', line, 's[2]')}" if k == 1 else "") + " end"
    role = {"a": "assistant", "u": "user"}[due]
    return f"list_min([{_edit(3, 'D', repr(''), f's[{k}]')}, {_edit(f'2 + {extra}', 'R', f'chr(10) || {role!r} || chr(58) || text', f's[{to}]')}, {kept}])"


_SQL = {
    "op4_chat_formatting": f"""
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
    sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    sum(14 + length(role) + length(regexp_replace(role, '[^\\\\#<:\\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\\\#<]', '', 'g')))::bigint as formatted_chars
from {_TURNS} group by conv_id""",
    "op5_ngram_jaccard_join": f"""
with recursive w as (select doc_id, {_WORDS} as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) >= 5 then [array_to_string(ws[i:i + 4], ' ') for i in range(1, len(ws) - 3)] when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from w),
n as (select doc_id, count(*) as n from s group by 1),
both_ways as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by 1, 2),
link as (select x, y from both_ways join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
reach as (select x, y from link union select r.x, l.y from reach r join link l on r.y = l.x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) as component_id
from documents d left join n on n.doc_id = d.doc_id left join (select x, min(y) as y from reach group by 1) m on m.x = d.doc_id""",
    "op11_exact_top_k": f"""
with v as ({_CELLS}), s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.cells, c.cells)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5""",
    "op12_vector_codes": f"""
with v as ({_CELLS}), w as (select max(len(cells)) // 16 as d from v), p as (select vec_id, label, k as part, cells[k * d + 1:(k + 1) * d] as x from v, w, range(16) as r(k)),
seed as (select vec_id, row_number() over (order by vec_id) - 1 as entry from (select vec_id from v order by vec_id limit 64)), b0 as (select part, entry, x as e from p join seed using (vec_id)),
{_lloyd(0)}, {_lloyd(1)}, {_assigned("a", 2)}, errors as (select vec_id, any_value(label) as label, string_agg(printf('%02x', entry), '' order by part) as code, sum(dist)::bigint as error from a2 group by 1)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
    (select sha256(string_agg(array_to_string(list_transform(e, lambda y: y::bigint), ','), ',' order by part, entry)) from b2) as codebooks_sha256 from errors""",
    "op13_conversation_repair": f"""
with recursive crcs as (select list(list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) as t from range(256) as r(n)),
base as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
ruled as (select *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: ascii(x)::bigint)), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 20 as r from base, crcs),
hurt as (select conv_id, turn, case r when 4 then 'user' else role end as role, case r when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case r when 3 then 2 else 1 end)) as copy from ruled where r <> 0),
placed as (select *, role[1:1] as own, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as seen from hurt),
judged as (select *, case when seen = '' then 'blank' when nth > 1 then 'duplicate' when right(seen, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault, coalesce(lag(own) over (partition by conv_id order by i) || own not in ('su', 'ua', 'au'), false) as odd from placed),
counts as (select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated, count(*) filter (odd) as illegal from judged group by 1),
back(conv_id, i, s) as (
    select conv_id, n, [{_step(0, '', '')}, {_step(4, 'II', 'user: assistant:')}, {_step(2, 'I', 'assistant:')}, {_step(0, '', '')}] from counts
    union all
    select conv_id, i - 1, [list_min([g[1], {_insert('user', 'u')}]), list_min([g[2], {_insert('user', 'u')}]), u, a] from (
        select *, list_min([g[3], {_insert('assistant', 'g[4]')}]) as u, list_min([g[4], {_insert('user', 'g[3]')}]) as a from (
            select b.conv_id, b.i, case when j.fault in ('blank', 'duplicate') then [{', '.join(_edit(3, 'D', "''", f's[{k}]') for k in (1, 2, 3, 4))}] else [{', '.join(_choices(k) for k in (1, 2, 3, 4))}] end as g
            from back b join judged j on j.conv_id is not distinct from b.conv_id and j.i = b.i)))
select c.conv_id, coalesce(k.gaps, 0)::bigint as gaps, coalesce(k.blank, 0)::bigint as blank, coalesce(k.duplicate, 0)::bigint as duplicate, coalesce(k.truncated, 0)::bigint as truncated, coalesce(k.illegal, 0)::bigint as illegal,
    coalesce(b.s[1].c, 0)::bigint as cost, coalesce(b.s[1].a, '') as audit, sha256(coalesce(b.s[1].t[2:], '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts k on k.conv_id is not distinct from c.conv_id left join back b on b.conv_id is not distinct from c.conv_id and b.i = 0""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express. The others learn or hash; tests/llm hold them against brute force, exact round trips or held-out rows."""
    return dict(_SQL)
