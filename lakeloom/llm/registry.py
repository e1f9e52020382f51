"""The registered query of each operator, with production parameters on whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.llm.ann import ann_cosine
from lakeloom.llm.bpe import encode_decode
from lakeloom.llm.langid import fit_languages, held_out, identify
from lakeloom.llm.license_scan import library, license_scan, license_sql
from lakeloom.llm.line_dedup import LINE_DEDUP_SQL, line_dedup
from lakeloom.llm.packing import pack_documents
from lakeloom.llm.simhash import simhash_components
from lakeloom.llm.substring_dedup import substring_dedup
from lakeloom.llm.topk import exact_topk
from lakeloom.llm.warc import read_archives, write_archives
from lakeloom.session import shared_dir, table


def op1_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    done = pack_documents(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = license_scan(table(spark, sf_dir, "documents"), library())
    return done.select("doc_id", "digest", "license", F.array_join("notices", ",").alias("notices"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann_cosine(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup(table(spark, sf_dir, "documents"), min_words=20, keep_layout=False)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), width=3, radius=2)


def op7_bpe(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    done = encode_decode(table(spark, sf_dir, "documents"), tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs.where(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {f.__name__: f for f in (op1_packing, op2_license_scan, op3_exact_topk, op4_ann, op5_substring_dedup, op6_simhash, op7_bpe, op8_line_dedup, op9_langid, op10_warc)}

#: Exact inner products in DuckDB: every query against every other row.
TOPK_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as w
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

#: A window's first start over all documents, in DuckDB; words are ASCII-space separated.
SUBSTRING_SQL = r"""
with d as (
  select doc_id, case when text is null then [] else regexp_extract_all(text, '[^\x20\x09-\x0D]+') end as w from documents
), g as (
  select doc_id, i, list_slice(w, i, i + 19) as k from (select doc_id, w, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)
), b as (
  select doc_id, i, row_number() over (partition by k order by doc_id, i) > 1 as late from g
), p as (
  select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as word from d
), m as (
  select p.doc_id, p.i, p.word,
         coalesce(max(case when b.late then 1 else 0 end) over (partition by p.doc_id order by p.i rows between 19 preceding and current row), 0) = 1 as gone
  from p left join b on p.doc_id = b.doc_id and p.i = b.i
), s as (
  select doc_id, cast(sum(case when gone then 1 else 0 end) as bigint) as n_removed,
         sha256(coalesce(string_agg(case when not gone then word end, ' ' order by i), '')) as kept_sha256
  from m group by doc_id
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(s.n_removed, 0) as n_removed, coalesce(s.kept_sha256, sha256('')) as kept_sha256
from d left join s on d.doc_id = s.doc_id
"""

#: Records, digests and revisits as the archives must give them back.
WARC_SQL = """
with p as (
  select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), g as (
  select payload_digest, payload_bytes, max(page_id) as last_page from p where payload_bytes >= 1000 group by all
)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when g.last_page <> p.page_id then 'revisit' else 'response' end as record_type,
       case when g.last_page <> p.page_id then g.last_page end as refers_to
from p left join g on p.payload_digest = g.payload_digest and p.payload_bytes = g.payload_bytes
"""

ORACLES: dict[str, str] = {"op2_license_scan": license_sql(), "op3_exact_topk": TOPK_SQL, "op5_substring_dedup": SUBSTRING_SQL, "op8_line_dedup": LINE_DEDUP_SQL, "op10_warc": WARC_SQL}
