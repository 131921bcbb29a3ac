"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import conversation_repair, dart_minhash, fingerprints, importance_resampling, mixing, packing, private_data, quality, repeats, token_counts, token_output, topk_search, warc_bundles
from sievework.llm.common import table


def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("rid")


def op2_one_permutation_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


#: The tables have no domain: sources are grouped by their names' last digit.
DOMAIN_SQL = "case when right(source, 1) in ('0', '1', '2') then 'web' when right(source, 1) in ('3', '4', '5', '6') then 'books' else 'forums' end"
MIX_WEIGHTS = {"domain": {"web": 5, "books": 3, "forums": 2}, "lang": {"en": 40, "fr": 20, "de": 20, "es": 20}}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 0.9, 3, 7


def op3_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), F.expr(DOMAIN_SQL), MIX_WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)


def op4_packed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.write_and_read(table(spark, sf_dir, "documents"), "op4")


def op5_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.strip_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), noted=repeats.PASSAGES)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes")


def op7_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op8_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundles.write_and_read(table(spark, sf_dir, "pages"), "op8")


OP8_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as payload_bytes, sha1(payload) as payload_digest from p),
m as (select payload_digest, max(page_id) as response from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when page_id < response then 'revisit' else 'response' end as record_type,
  case when page_id < response then response end as refers_to
from d left join m using (payload_digest)
"""


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def _weight_sql(level: str) -> str:
    return f"case {level} " + " ".join(f"when '{name}' then {w}" for name, w in MIX_WEIGHTS.get(level, {}).items()) + " else 1 end" if level in MIX_WEIGHTS else "1"


def _divide_sql(name: str, nodes: str, parent: str, level: str) -> str:
    """The water level among the children of each parent: nodes has parent, level, cap, w and target."""
    by = f"partition by {parent}" if parent else ""
    return f"""{name}_a as (
  select *, coalesce(sum(cap) over (o rows between unbounded preceding and 1 preceding), 0) as used, sum(w) over (o rows between current row and unbounded following) as l
  from {nodes} window o as ({by} order by cap::decimal(38,0) / w::decimal(38,0), {level})
), {name}_b as (
  select *, min((cap::hugeint * l::hugeint <= w::hugeint * (target - used)::hugeint)::int) over ({by} order by cap::decimal(38,0) / w::decimal(38,0), {level}) as filled from {name}_a
), {name}_c as (
  select *, target - coalesce(sum(case when filled = 1 then cap end) over p, 0) as rest, sum(case when filled = 0 then w end) over p as open from {name}_b window p as ({by})
), {name} as (select * exclude (target), case when filled = 1 then cap else w::hugeint * rest::hugeint // open::hugeint end::bigint as given from {name}_c)"""


OP3_SQL = f"""
with r as (
  select doc_id, {DOMAIN_SQL} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::bigint as n_tokens from documents
), leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens, sum(n_tokens)::bigint * {MIX_EPOCHS} as cap from r group by all having sum(n_tokens) > 0),
goal as (select least(floor(sum(tokens) * {MIX_BUDGET}::double)::bigint, sum(cap)::bigint) as target from leaves),
n1 as (select domain, sum(cap)::bigint as cap, {_weight_sql("domain")} as w, any_value(target) as target from leaves, goal group by domain),
{_divide_sql("d1", "n1", "", "domain")},
n2 as (select domain, lang, sum(leaves.cap)::bigint as cap, {_weight_sql("lang")} as w, any_value(given) as target from leaves join d1 using (domain) group by domain, lang),
{_divide_sql("d2", "n2", "domain", "lang")},
n3 as (select domain, lang, source, sum(leaves.cap)::bigint as cap, 1 as w, any_value(given) as target from leaves join d2 using (domain, lang) group by domain, lang, source),
{_divide_sql("d3", "n3", "domain, lang", "source")},
plan as (select domain, lang, source, given // tokens as epochs, given % tokens as part from d3 join leaves using (domain, lang, source) where given > 0),
e as (
  select r.*, epochs, part, epoch, ('0x' || substr(md5('{MIX_SEED}|' || epoch || '|' || coalesce(doc_id::varchar, '')), 1, 15))::bigint as "order"
  from r join plan using (domain, lang, source), unnest(range(0, epochs + 1)) as t(epoch)
), c as (
  select *, coalesce(sum(n_tokens) over (partition by domain, lang, source, epoch order by "order", doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0)::bigint as before from e
)
select doc_id, domain, lang, source, epoch, "order", n_tokens, (case when epoch < epochs then n_tokens else least(n_tokens, part - before) end)::bigint as taken
from c where epoch < epochs or (part > 0 and before < part)
"""

OP10_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""



def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.audits_with_digest(conversation_repair.damage(table(spark, sf_dir, "conversations")))


#: CRC-32 of a text's UTF-8 bytes; crc_table has the 256 steps of a byte.
_CRC_TABLE_SQL = """crc_table as (
  select list(list_reduce(range(8), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b) order by b) as steps from range(256) as t(b)
)"""


def _crc_sql(value: str) -> str:
    octets = f"list_transform(range(octet_length(encode({value}))), lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::bigint)"
    return f"xor(4294967295, list_reduce({octets}, lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]), 4294967295))"


#: For each state (1 nothing, 2 system, 3 user, 4 assistant) the best (cost, letters, lines), from the last row to the first.
OP11_SQL = f"""
with recursive {_CRC_TABLE_SQL},
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_crc_sql("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as kind from conversations, crc_table),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from given, unnest(range(case when kind = 0 then 0 when kind = 3 then 2 else 1 end)) as t(copy)
),
placed as (
  select *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as kept,
    row_number() over (partition by conv_id order by turn nulls first, role, md5(len(role) || ':' || role || text)) as place from damaged
),
marked as (
  select *, kept = '' as blank, row_number() over (partition by conv_id, role, text order by place) > 1 as again, kept <> '' and right(kept, 1) not in ('.', '!', '?') as unfinished, left(role, 1) as initial from placed
),
judged as (select *, blank or again as doomed, (unfinished and not again)::int as extra, role || ':' || text as line, lag(initial) over (partition by conv_id order by place) as earlier from marked),
counts as (
  select conv_id, max(place) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count_if(blank)::bigint as blank, count_if(again and not blank)::bigint as duplicate,
    count_if(unfinished and not again)::bigint as truncated, count_if(earlier is not null and earlier || initial not in ('su', 'ua', 'au'))::bigint as illegal from judged group by conv_id
),
walk as (
  select conv_id, n + 1 as place, (0, '', []::varchar[]) as s0, (4, 'II', ['user:', 'assistant:']) as s1, (2, 'I', ['assistant:']) as s2, (0, '', []::varchar[]) as s3 from counts
  union all
  select conv_id, place, least(r0, (r2[1] + 2, 'I' || r2[2], list_prepend('user:', r2[3]))), least(r1, (r2[1] + 2, 'I' || r2[2], list_prepend('user:', r2[3]))),
    least(r2, (r3[1] + 2, 'I' || r3[2], list_prepend('assistant:', r3[3]))), least(r3, (r2[1] + 2, 'I' || r2[2], list_prepend('user:', r2[3])))
  from (
    select w.conv_id, j.place,
      least((s0[1] + 3, 'D' || s0[2], s0[3]), case when not doomed then (s2[1] + 2 + extra, 'R' || s2[2], list_prepend('user:' || text, s2[3])) end,
        case when not doomed and initial = 's' then (s1[1] + extra, 'K' || s1[2], list_prepend(line, s1[3])) when not doomed and initial = 'u' then (s2[1] + extra, 'K' || s2[2], list_prepend(line, s2[3])) end) as r0,
      least((s1[1] + 3, 'D' || s1[2], s1[3]), case when not doomed then (s2[1] + 2 + extra, 'R' || s2[2], list_prepend('user:' || text, s2[3])) end,
        case when not doomed and initial = 'u' then (s2[1] + extra, 'K' || s2[2], list_prepend(line, s2[3])) end) as r1,
      least((s2[1] + 3, 'D' || s2[2], s2[3]), case when not doomed then (s3[1] + 2 + extra, 'R' || s3[2], list_prepend('assistant:' || text, s3[3])) end,
        case when not doomed and initial = 'a' then (s3[1] + extra, 'K' || s3[2], list_prepend(line, s3[3])) end) as r2,
      least((s3[1] + 3, 'D' || s3[2], s3[3]), case when not doomed then (s2[1] + 2 + extra, 'R' || s2[2], list_prepend('user:' || text, s2[3])) end,
        case when not doomed and initial = 'u' then (s2[1] + extra, 'K' || s2[2], list_prepend(line, s2[3])) end) as r3
    from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.place = w.place - 1
  )
),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, coalesce(s0[1], 0)::bigint as cost, coalesce(s0[2], '') as audit, sha256(coalesce(array_to_string(s0[3], chr(10)), '')) as repaired_sha256
from every e left join counts c on c.conv_id is not distinct from e.conv_id left join walk w on w.conv_id is not distinct from e.conv_id and w.place = 1
"""


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP12_SQL = f"""
with {_CRC_TABLE_SQL},
texts as (select 0 as side, doc_id, text, row_number() over () as row from documents union all select 1, null, text, null from benchmark),
words as (
  select side, doc_id, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts
),
runs as (select side, row, array_to_string(w[i:i + k - 1], ' ') as run from words, unnest(range(1, 4)) as a(k), unnest(range(1, len(w) - k + 2)) as b(i)),
distinct_runs as (select distinct run from runs),
hashed as (select run, ({_crc_sql("run")} % 10000)::int as bucket from distinct_runs, crc_table),
placed as (select side, row, bucket from runs join hashed using (run)),
totals as (select side, bucket, count(*) as n from placed group by all),
sizes as (select coalesce(sum(n) filter (side = 0), 0)::double as s, coalesce(sum(n) filter (side = 1), 0)::double as t from totals),
gains as (
  select b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::double * (sizes.s + 10000) / ((coalesce(s.n, 0) + 1)::double * (sizes.t + 10000))))::bigint as gain
  from range(10000) as b(bucket) left join totals s on s.side = 0 and s.bucket = b.bucket left join totals t on t.side = 1 and t.bucket = b.bucket, sizes
),
sums as (select row, count(*) as n_features, sum(gain) as weight from placed join gains using (bucket) where side = 0 group by row),
scored as (
  select doc_id, len(w) >= 20 as long_enough, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('42:' || coalesce(doc_id::varchar, '')), 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from words left join sums using (row) where side = 0
),
ranked as (select *, row_number() over (partition by long_enough order by score desc, doc_id nulls last) as place, count(*) over (partition by long_enough) as n from scored)
select doc_id, n_features, weight, score, case when long_enough and place <= 5 * n // 100 then place end::bigint as rank from ranked
"""


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.fit_and_find(table(spark, sf_dir, "documents")).drop("redacted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_dart_minhash, op2_one_permutation_fingerprints, op3_hierarchical_mixing, op4_packed_matrices, op5_sum_of_squares_packing, op6_suffix_array_dedup, op7_unigram_token_counts, op8_warc_bundles, op9_compression_quality, op10_segment_topk, op11_conversation_repair, op12_importance_resampling, op13_private_data)}


def oracle_sql() -> dict[str, str]:
    return {"op3_hierarchical_mixing": OP3_SQL, "op8_warc_bundles": OP8_SQL, "op10_segment_topk": OP10_SQL, "op11_conversation_repair": OP11_SQL, "op12_importance_resampling": OP12_SQL}
