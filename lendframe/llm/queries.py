"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lendframe.llm import (
    byte_bpe,
    embedding_dedup,
    license_scan,
    line_dedup,
    merkle,
    mixing,
    ngram_model,
    oracle,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash,
    spelling,
    token_count,
)
from lendframe.llm.common import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = simhash.memberships(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return member.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.token_counts(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return embedding_dedup.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(
        _table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size")), "mix-sizes"
    )
    return mixing.mix(sized, "size").select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = byte_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", *byte_bpe.digests())


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.audit(_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.siblings_sha256(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_model.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_simhash": op2_simhash,
    "op3_secret_scan": op3_secret_scan,
    "op4_token_count": op4_token_count,
    "op5_quality_rules": op5_quality_rules,
    "op6_license_scan": op6_license_scan,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_source_mixing": op8_source_mixing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_merkle": op11_merkle,
    "op12_ngram_scores": op12_ngram_scores,
    "op13_spelling": op13_spelling,
}

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op1_line_dedup": f"""
with split as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents
), line as (
  select doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from split
), keyed as (
  select *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line
), shared as (
  select key, max(doc_id) as top from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), marked as (
  select k.doc_id, k.pos, k.line, coalesce(k.doc_id < s.top, false) as lost from keyed k left join shared s on k.key = s.key
)
select doc_id, count(*) as n_lines, count(*) filter (where lost) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not lost), '')) as kept_sha256
from marked group by doc_id
""",
    "op7_embedding_dedup": """
with recursive vec as (
  select vec_id, embedding::double[] as v from embeddings
), usable as (
  select vec_id, v from vec
  where len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), scaled as (
  select vec_id, list_transform(v, lambda x: x / list_max(list_transform(v, lambda y: abs(y)))) as v from usable
), link as (
  select a.vec_id as a, b.vec_id as b from scaled a join scaled b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_inner_product(a.v, b.v) >= 0.95 * sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))
), reach as (
  select a as node, a as root from link
  union
  select l.b, r.root from reach r join link l on l.a = r.node where r.root < l.b
), named as (
  select node, min(root) as root from reach group by node
)
select v.vec_id, (select count(*) from link l where l.a = v.vec_id) as n_links,
       coalesce(n.root, v.vec_id) as component_id, v.vec_id = coalesce(n.root, v.vec_id) as kept
from vec v left join named n on n.node = v.vec_id
""",
    "op8_source_mixing": """
with doc as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint as hash
  from documents
), src as (
  select source, sum(size)::bigint as source_size from doc group by source
), ranked as (
  select *, ([5, 2, 1])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, source_size * 2.0::double as cap from src
), level as (
  select *, cap / weight as ratio,
         sum(source_size) over () * 1.5::double
           - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
         sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as open_weight
  from ranked
), base as (
  select rest, open_weight from level where ratio * open_weight >= rest order by ratio, source nulls last limit 1
), dealt as (
  select source, source_size, least(cap, base.rest::double * weight / base.open_weight) as target from level, base
), plan as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from dealt
), hashed as (
  select source, hash, sum(size) as size, sum(sum(size)) over (partition by source order by hash) as upto from doc group by source, hash
), cut as (
  select h.source, h.hash,
         h.upto <= floor(p.target - p.whole * p.source_size)
           or (h.upto - h.size <= floor(p.target - p.whole * p.source_size)
               and 2 * (floor(p.target - p.whole * p.source_size) - (h.upto - h.size)) > h.size) as taken
  from hashed h join plan p on h.source is not distinct from p.source
)
select d.doc_id, d.size, p.source_size, p.target,
       (d.size * (p.whole + case when c.taken and p.whole < 2 then 1 else 0 end))::bigint as taken
from doc d join plan p on d.source is not distinct from p.source
join cut c on d.source is not distinct from c.source and d.hash = c.hash
""",
}

ORACLE_SQL["op6_license_scan"] = license_scan.oracle_sql()
ORACLE_SQL["op11_merkle"] = oracle.MERKLE
ORACLE_SQL["op13_spelling"] = oracle.SPELLING
ORACLE_SQL["op12_ngram_scores"] = oracle.NGRAMS
