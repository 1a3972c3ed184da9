"""The registered queries of this subpackage: thin wrappers that derive each contract's columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm.decontam import find_contamination
from wavemill.llm.exact import exact_dedup
from wavemill.llm.licenses import names, scan_licenses, scan_sql
from wavemill.llm.merkle import FIELDS, folded, leaf_digest, merkle_proofs, merkle_sql, proof_text
from wavemill.llm.negatives import mine_hard_negatives
from wavemill.llm.pii import KINDS, find_personal_data
from wavemill.llm.pieces import encode_pieces
from wavemill.llm.secrets import BASE, scan_secrets, spans_text
from wavemill.llm.shards import shard_documents
from wavemill.llm.shared import ascii_lower, shared_folder
from wavemill.llm.simhash import near_components
from wavemill.llm.tokens import new_folder, read_tokens, write_tokens
from wavemill.llm.toxicity import HELD_OUT, fit, fold, score
from wavemill.llm.urls import filter_urls, rule_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules of op1, fixed by its contract.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def _query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@_query(
    "op1_url_filter",
    f"""
with p as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) end rest from pages),
q as (select page_id, coalesce({_LOWER.format("regexp_extract(rest, '^[^/?#]*')")}, '') host,
             coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path from p),
r(h, pre, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
                        ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select page_id, host, path, h || pre rule, v, row_number() over (partition by page_id order by length(h || pre) desc nulls last) k
      from q left join r on (host = h or suffix(host, '.' || h)) and prefix(path, pre))
select page_id, host, path, rule, coalesce(v, 'allow') verdict from m where k = 1""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, URL_RULES))


@_query(
    "op2_exact_dedup",
    f"""
with t as (select doc_id, sha256({_LOWER.format("coalesce(text, '')")}) s from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, s text_sha256
from t window w as (partition by s)""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir), hash_all=True).drop("_text_key")


@_query("op3_secret_scan")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


@_query("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _documents(spark, sf_dir)
    folder = new_folder(docs)
    manifest = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(manifest, folder).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


@_query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_components(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = find_personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    return found.withColumn("_base", base).select(
        "doc_id",
        *[F.size(F.filter("_base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


@_query("op7_sentencepiece")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = encode_pieces(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), decoded=True)
    return found.select("doc_id", F.size("ids").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


@_query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


@_query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, slot_map = shard_documents(_documents(spark, sf_dir), 24)
    slot_map.store(spark, f"{shared_folder(spark).rstrip('/')}/slot-maps-{uuid.uuid4().hex}")
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot"
    )


@_query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_query("op11_license_scan", scan_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(_documents(spark, sf_dir)).withColumn("_base", F.filter("found", lambda f: f["base"]))
    starts = F.transform("_base", lambda f: f["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(F.col("_base")).alias("base_labels"),
        names(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)), 6).alias("score"),
    )


@_query("op12_merkle_manifest", merkle_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowered = leaf_digest([ascii_lower(F.col(c)) if c == "text" else F.col(c) for c in FIELDS])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lowered)
    rows = merkle_proofs(_documents(spark, sf_dir), carried={"tampered": tampered})
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@_query(
    "op13_hard_negatives",
    """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end::bigint label, list_transform(embedding, lambda e: floor(256 * e::double)) x
           from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda e: e is null or not isfinite(e))) = 0),
s as (select a.vec_id anchor_id, b.vec_id, a.label = b.label same, list_inner_product(a.x, b.x)::bigint score from v a join v b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id negative_id, s.score negative_score, row_number() over (partition by anchor_id, positive_id order by score desc, s.vec_id) k
      from p join s using (anchor_id) where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, k::int rank, negative_id, positive_score, negative_score from n where k <= 3""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(rows, F.col("vec_id") % 50 == 0)
