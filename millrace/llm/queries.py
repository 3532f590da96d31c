"""The queries of this package: thin wrappers that shape operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html, language, minhash, mixing, neighbours, quality, repeats, vectors, warc
from .common import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@query
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


@query
def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.95)
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


@query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neighbours.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), rank_file(), split_pattern())


@query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200, keep="none", result="digest")


@query
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query
def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write_archives(table(spark, sf_dir, "pages"), dedup_bytes=0)
    records = warc.check_revisits(warc.read_archives(archives, with_payload=False))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_mixing"] = """
with rows0 as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size
  from documents),
cells_each as (select 2 * (count(*) // 1024) + 1 as b from rows0),
rows1 as (
  select doc_id, source, size, floor(log2(size + 1))::int as cls,
    coalesce(doc_id, 0) % (select b from cells_each) as m, (select b from cells_each) as b from rows0),
rows2 as (
  select doc_id, source, size, row_number() over (partition by source order by cls, (m + b) % b, size, doc_id) as k
  from rows1),
sizes as (select source, sum(size)::bigint as source_size from rows0 group by source),
weighed as (
  select source, source_size, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double as weight
  from sizes),
filled as (select *, (source_size * 3)::double / weight as fill from weighed),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over w, 0))::double
    / (sum(weight) over () - coalesce(sum(weight) over w, 0))::double as lv
  from filled window w as (order by fill, source nulls last rows between unbounded preceding and 1 preceding)),
water as (select min_by(lv, fill) as level from levels where fill > lv),
targets as (
  select source, source_size, least((source_size * 3)::double, weight * coalesce((select level from water), 0)) as target
  from levels),
rated as (
  select r.doc_id, r.size, t.source_size, t.target, r.k,
    case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate
  from rows2 r join targets t on r.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (least(floor({offset} + k * rate) - floor({offset} + (k - 1) * rate), 3) * size)::bigint as taken
from rated
""".replace("{offset}", repr(__import__("random").Random(8).randrange(1 << 20) / (1 << 20)) + "::double")


ORACLE["op10_warc"] = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex, octet_length(encode(coalesce(html, ''))) as n from pages),
g as (select hex, min(page_id) as first from p group by hex),
b as (
  select page_id, n, first,
    list_aggregate(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(hex || '0000', ((i * 5) // 4 + 1)::int, 2))::int >> ((8 - 5 - (i * 5) % 4))::int) & 31) + 1, 1)), 'string_agg', '') as payload_digest
  from p join g using (hex))
select page_id, n::bigint as payload_bytes, payload_digest,
  case when first is null or page_id = first then 'response' else 'revisit' end as record_type,
  case when first is null or page_id = first then null else first end::bigint as refers_to
from b
"""


ORACLE["op2_embedding_dedup"] = """
with recursive v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach as (select vec_id as x, vec_id as y from v union select r.x, l.y from reach r join links l on l.x = r.y),
n as (select x, count(*) as n from links group by x),
c as (select x, min(y) as c from reach group by x)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.c, e.vec_id) as component_id, coalesce(c.c, e.vec_id) = e.vec_id as kept
from embeddings e left join n on n.x = e.vec_id left join c on c.x = e.vec_id
"""


ORACLE["op3_nearest"] = """
with v as (
  select distinct vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.e, b.e) as score
  from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 50 = 0),
placed as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs)
select query_id, rank::int as rank, vec_id, score from placed where rank <= 5
"""


ORACLE["op7_repeats"] = """
with d as (select row_number() over () as r, doc_id, encode(coalesce(text, '')) as b from documents),
lengths as (select r, doc_id, b, octet_length(b)::bigint as n from d),
places as (select r, unnest(range(1, n - 198)) as i from lengths where n >= 200),
windows as (select p.r, p.i, l.b[p.i:p.i + 199] as s from places p join lengths l using (r)),
twice as (select s from windows group by s having count(*) > 1),
starts as (select r, i from windows where s in (select s from twice)),
flags as (select r, i, coalesce(i - lag(i) over (partition by r order by i) > 200, true)::int as new from starts),
runs as (select r, i, sum(new) over (partition by r order by i) as run from flags),
spans as (select r, min(i) as low, max(i) + 199 as high from runs group by r, run),
gaps as (
  select s.r, s.low, hex(l.b[coalesce(lag(s.high) over (partition by s.r order by s.low), 0) + 1:s.low - 1]) as kept
  from spans s join lengths l using (r)
  union all select r, n + 1, hex(b[coalesce((select max(high) from spans s where s.r = l.r), 0) + 1:n]) from lengths l),
kept as (select r, sha256(unhex(string_agg(kept, '' order by low))) as kept_sha256 from gaps group by r),
gone as (select r, sum(high - low + 1) as n_removed, count(*) as n_spans from spans group by r)
select doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, kept_sha256
from lengths join kept using (r) left join gone using (r)
"""
