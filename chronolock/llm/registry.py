"""The queries of the corpus operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolock.llm import conversation_repair, decontamination, line_dedup, order_minhash, packing, pii_bootstrap, quality_mil, simhash_anchor, token_counts, url_filters, warc_zstd, whitening, wrapper_extract
from chronolock.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), short=True)


def op2_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zstd.round_trip(table(spark, sf_dir, "pages"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edit_fingerprints(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op6_wrapper_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_extract.main_text(table(spark, sf_dir, "pages"))


def op7_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_mil.score(docs, quality_mil.train(docs, table(spark, sf_dir, "labels")))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_anchor.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii_bootstrap.ALL_KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(k: int):
        return F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{pii_bootstrap.KINDS[k]}")

    counts = [count(k) for k in range(len(pii_bootstrap.KINDS))]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


#: Fixed values of the contract: host, path and verdict of each rule.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"), spark.createDataFrame(list(URL_RULES), url_filters.RULES))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_warc_zstd, op3_decontamination, op4_order_minhash, op5_token_counts, op6_wrapper_extract, op7_quality_mil, op8_simhash_near_dedup, op9_pii_bootstrap, op10_best_fit_packing, op11_conversation_repair, op12_embedding_whitening, op13_url_filters)}

#: Base 32 of SHA-1 from the bits of the hash, five at a time; revisits by the largest page of a payload.
_WARC = """
with p as (select page_id, url, coalesce(html, '') as payload from pages),
b as (select *, cast(unhex(sha1(payload)) as bit)::varchar as bits, max(page_id) over (partition by payload) as kept from p)
select page_id, url, octet_length(encode(payload)) as payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + 16 * (substr(bits, 5 * i + 1, 1) = '1')::int + 8 * (substr(bits, 5 * i + 2, 1) = '1')::int + 4 * (substr(bits, 5 * i + 3, 1) = '1')::int + 2 * (substr(bits, 5 * i + 4, 1) = '1')::int + (substr(bits, 5 * i + 5, 1) = '1')::int as bigint), 1)), 'string_agg', '') as payload_digest,
  case when page_id = kept then 'response' else 'revisit' end as record_type, case when page_id < kept then kept end as refers_to
from b"""

_RULES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
#: Every url against every rule of the short list.
_URLS = f"""
with u as (select row_number() over () as row_no, page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
r(rule_host, rule_path, says) as (values {_RULES}),
b as (select u.*, r.*, row_number() over (partition by row_no order by length(rule_host || rule_path) desc nulls last, length(rule_host) desc) as k
  from u left join r on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select page_id, host, path, rule_host || rule_path as rule, coalesce(says, 'allow') as verdict from b where k = 1"""


def _repair_sql() -> str:
    """Conversations by recursion, from the last row to the first; a way is its cost in nine digits and its
    letters, so the least text is the least way."""

    def way(cost: str, letter: str, then: str) -> str:
        return f"lpad(cast(cast(left({then}, 9) as int) + {cost} as varchar), 9, '0') || '{letter}' || substr({then}, 10)"

    def row(q: int) -> str:
        ways = [way("2", "D", f"s.v{q}")]
        for letter, then in conversation_repair.NEXT[q].items():
            stays = "f not in ('blank', 'duplicate')"
            ways.append(f"case when {stays} and initial = '{letter}' then {way('more', 'K', f's.v{then}')} end")
            if letter in conversation_repair.ROLE:
                ways.append(f"case when {stays} then {way('more + 1', 'R', f's.v{then}')} end")
        return f"least({', '.join(ways)})"

    def inserted(q: int, rows: str, now: str) -> str:
        then = next(t for x, t in conversation_repair.NEXT[q].items() if x in conversation_repair.ROLE)
        return f"least({rows}{q}, {way('5', 'I', f'{now}{then}')})"

    none = "'900000000'"
    level = ", ".join(f"{row(q)} as w{q}" for q in range(4))
    one = ", ".join(f"{inserted(q, 'w', 'w')} as x{q}" for q in range(4))
    two = ", ".join(f"{inserted(q, 'w', 'x')} as v{q}" for q in range(4))
    return f"""
with recursive given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations),
hit as (select *, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(key) + 1), lambda i: ascii(key[i])::ubigint)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0::ubigint, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::ubigint * (x & 1)))), 4294967295::ubigint) % 20 as hit from given),
damaged as (select conv_id, turn, case hit when 4 then 'user' else role end as role, case hit when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case hit when 3 then 2 else 1 end)) as copy from hit where hit <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again, left(role, 1) as initial from damaged),
faulty as (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when again > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 'truncated' else '' end as f,
  lag(initial) over (partition by conv_id order by i) || initial as pair from ordered),
marked as (select *, case f when 'truncated' then 5 else 0 end as more from faulty),
counts as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (f = 'blank') as blank, count(*) filter (f = 'duplicate') as duplicate, count(*) filter (f = 'truncated') as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, count(*) as n from marked group by conv_id),
step as (
  select conv_id, n as i, {two} from (select *, {one} from (select conv_id, n, '000000000' as w0, {none} as w1, {none} as w2, '000000000' as w3 from counts))
  union all
  select conv_id, i, {two} from (select *, {one} from (select s.conv_id, s.i - 1 as i, {level} from step s join marked m on m.conv_id is not distinct from s.conv_id and m.i = s.i))
),
best as (select conv_id, cast(left(v0, 9) as bigint) as cost, substr(v0, 10) as audit from step where i = 0),
letters as (select conv_id, unnest(range(1, length(audit) + 1)) as k, audit, audit[k] as letter from best),
placed as (select *, count(*) filter (letter <> 'I') over w as i, count(*) filter (letter <> 'D') over w as place from letters window w as (partition by conv_id order by k)),
left_ as (select p.conv_id, p.place, p.letter, case when letter <> 'I' then m.role end as own, case when letter = 'I' then '' else m.text end as text from placed p left join marked m on m.conv_id is not distinct from p.conv_id and m.i = p.i where letter <> 'D'),
shifted as (select *, max(case when place = 1 and letter = 'K' and left(own, 1) = 's' then 1 else 0 end) over (partition by conv_id) as lead_ from left_),
said as (select conv_id, string_agg(case when letter = 'K' then own when (place - lead_) % 2 = 1 then 'user' else 'assistant' end || ':' || text, chr(10) order by place) as said from shifted group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join counts on counts.conv_id is not distinct from c.conv_id left join best on best.conv_id is not distinct from c.conv_id left join said on said.conv_id is not distinct from c.conv_id"""


ORACLE_SQL = {"op2_warc_zstd": _WARC, "op11_conversation_repair": _repair_sql(), "op13_url_filters": _URLS}
