"""The operators over the tables they are made for, and what SQL can say of them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import ann, bpe, decontam, html_extract, language, licences, line_dedup, secret_scan, simhash, warc

#: Rank file and split pattern of the tokenizer that the queries use.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page by its host's consensus path."""
    return html_extract.extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products found for every vector whose id 20 divides."""
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", simhash.fingerprint_text().alias("fingerprint"), "component_id")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page; the text model learns from the documents' labels."""
    model = language.train(_table(spark, sf_dir, "documents"))
    return language.identify_pages(_table(spark, sf_dir, "pages"), model).select("page_id", "language", F.round("posterior", 6).alias("posterior"), "accepted")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines it repeats from earlier ones."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_removed")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that occurrences of benchmark windows hit."""
    found = decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), proximity=decontam.PROXIMITY)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", F.array_join("near", ",").alias("near_items"))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digest of every document and the licence that it is, if any."""
    return licences.scan(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the archives and the merged index give it back."""
    return warc.archive(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each distinct text scanned once."""
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    findings, _ = secret_scan.scan(docs)
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    spans = secret_scan.spans_text(F.col("found"))
    return findings.select(F.col("path").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and what they decode to, as digests."""
    return bpe.encode(_table(spark, sf_dir, "documents"), RANKS, PATTERN, with_ids=False)


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_ann, op3_simhash, op4_language, op5_line_dedup, op6_decontam, op7_licences, op8_warc, op9_secrets, op10_bpe)}


def _decontam_sql() -> str:
    words = lambda c: f"regexp_extract_all(translate(coalesce({c}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    width = decontam.WINDOW
    return f"""
with items as (select cast(item_id as varchar) as item, {words("text")} as w from benchmark),
sized as (select item, w, least({width}, len(w)) as n from items where len(w) > 0),
windows as (select distinct item, n, array_to_string(w[i:i + n - 1], ' ') as body
  from (select item, w, n, unnest(generate_series(1, len(w) - n + 1)) as i from sized)),
docs as (select doc_id, {words("text")} as w from documents),
places as (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) as i
  from docs, (select distinct n from windows) where len(w) >= n),
hits as (select doc_id, item, i, places.n from places join windows
  on windows.n = places.n and windows.body = array_to_string(w[i:i + places.n - 1], ' ')),
hit_words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from hits) group by doc_id),
hit_items as (select doc_id, list_sort(list(distinct item)) as items from hits group by doc_id),
tokens as (select doc_id, unnest(w) as term, unnest(generate_series(1, len(w))) as pos from docs),
frequencies as (select term, count(distinct doc_id) as n from tokens group by term),
terms as (select body, unnest(list_distinct(string_split(body, ' '))) as term from (select distinct body from windows)),
ranked as (select body, terms.term, row_number() over (partition by body order by f.n, terms.term) as k, count(f.n) over (partition by body) = count(*) over (partition by body) as whole
  from terms left join frequencies f on terms.term = f.term),
rarest as (select body, max(term) filter (where k = 1) as t1, max(term) filter (where k = 2) as t2, max(term) filter (where k = 3) as t3 from ranked where whole group by body),
close as (select distinct r.t1, r.t2, r.t3, a.doc_id from (select distinct t1, t2, t3 from rarest) r join tokens a on a.term = r.t1
  left join tokens b on b.term = r.t2 and b.doc_id = a.doc_id left join tokens c on c.term = r.t3 and c.doc_id = a.doc_id
  where (r.t2 is null or b.pos is not null) and (r.t3 is null or c.pos is not null)
    and greatest(a.pos, coalesce(b.pos, a.pos), coalesce(c.pos, a.pos)) - least(a.pos, coalesce(b.pos, a.pos), coalesce(c.pos, a.pos)) + 1 <= {decontam.PROXIMITY}),
near as (select doc_id, array_to_string(list_sort(list(distinct item)), ',') as near_items from close join rarest
  on close.t1 = rarest.t1 and close.t2 is not distinct from rarest.t2 and close.t3 is not distinct from rarest.t3 join windows on windows.body = rarest.body group by doc_id)
select docs.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(len(items), 0) as bigint) as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated, coalesce(near_items, '') as near_items
from docs left join near on docs.doc_id = near.doc_id left join hit_words on docs.doc_id = hit_words.doc_id left join hit_items on docs.doc_id = hit_items.doc_id"""


def _licences_sql() -> str:
    rows = ", ".join("('" + name + "', '" + body.replace("'", "''") + "')" for name, body in licences.LICENCES.items())
    return f"""
with texts(licence, body) as (values {rows}),
forms as (select licence, {licences.canonical_sql("body")} as form from texts union all select licence, {licences.canonical_sql("body", titles=False)} from texts),
known as (select sha256(form) as digest, min(licence) as licence from forms group by 1),
hashed as (select doc_id, sha256({licences.canonical_sql("coalesce(text, '')")}) as digest from documents)
select doc_id, hashed.digest, licence from hashed left join known on hashed.digest = known.digest and hashed.digest <> sha256('')"""


def _warc_sql() -> str:
    return f"""
with p as (select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p group by 1)
select page_id, payload_bytes, p.payload_digest,
  case when payload_bytes >= {warc.LEAST_REVISIT} and first < page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= {warc.LEAST_REVISIT} and first < page_id then first end as refers_to
from p join f on p.payload_digest = f.payload_digest"""


def _secrets_sql() -> str:
    parts = []
    for kind, (_, pattern, group, least) in enumerate(secret_scan.RULES):
        if group == 0:  # a run that is long enough is matched alike if shorter ones are not matched at all
            pattern = pattern.removesuffix("+") + "{%d,}" % (least - len(pattern.partition("[")[0]))
        quoted = pattern.replace("'", "''")
        parts.append(f"""
select doc_id, {kind} as kind, i, sum(length(gaps[i]) + length(coalesce(matches[i - 1], ''))) over (partition by doc_id order by i) as start, matches[i] as found, counted[i] as counted, {least} as least
from (select doc_id, gaps, matches, counted, unnest(generate_series(1, len(matches))) as i from (
  select doc_id, string_split_regex(t, '{quoted}') as gaps, regexp_extract_all(t, '{quoted}') as matches, regexp_extract_all(t, '{quoted}', {group}) as counted
  from (select doc_id, text as t from documents where regexp_matches(text, '{quoted}'))))""")
    return f"""
with every as ({" union all ".join(parts)}),
kept as (select doc_id, kind, cast(start as bigint) as start, cast(start + length(found) as bigint) as stop from every where length(counted) >= least),
joined as (select doc_id, count(*) filter (where kind = 0) as n_assign, count(*) filter (where kind = 1) as n_access, count(*) filter (where kind = 2) as n_hex,
  string_agg((['assign', 'access', 'hex'])[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) as spans from kept group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join joined j on d.doc_id = j.doc_id"""


#: Where SQL can't express an operator, or is too slow on whole tables, its tests hold it against brute force.
ORACLE_SQL = {"op6_decontam": _decontam_sql(), "op7_licences": _licences_sql(), "op8_warc": _warc_sql(), "op9_secrets": _secrets_sql()}
