"""The operators as named queries over the given tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, langid, license_scan, line_runs, oracle, packing, quality, secrets, simhash_trie, topk, url_cascade, warc, whitening
from .common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    vectors = vectors.select("vec_id", topk.scaled(vectors, "embedding", 64.0).alias("vector"))
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, 20)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.col("base")
    return found.select(
        "doc_id",
        secrets.count_kind(base, 0).alias("n_assign"),
        secrets.count_kind(base, 1).alias("n_access"),
        secrets.count_kind(base, 2).alias("n_hex"),
        F.sha2(secrets.written(base), 256).alias("base_sha256"),
        secrets.written(F.array_sort(F.concat("base", "added"))).alias("spans"),
        secrets.count_kind(F.col("added"), 3).alias("n_random"),
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    items = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    hit = decontaminate.n_hit(F.col("hits"))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_runs.dedup_lines(docs, min_docs=10, min_chars=1).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = table(spark, sf_dir, "labels").select("doc_id", "quality").where(quality.fold("doc_id", 3) != 1)
    docs = docs.withColumn("held_out", quality.fold("doc_id", 3) == 1)
    return quality.scored(docs, quality.train(docs, learn)).drop("text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.near_duplicates(table(spark, sf_dir, "documents"), 3, 2, keep=["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", quality.fold("doc_id", 5) == 0)
    model = langid.train(docs.where("not held_out"))
    return langid.identified(docs.drop("lang"), model).drop("text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"), min_bytes=0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: Hosts with a label that begins with one of these words are listed.
LISTED_LABELS = "(^|[.])(adult|casino|porn|warez)"
#: Places that some page of the table reaches by a link with such a parameter are listed.
TRACKED_LINK = "[?&](utm_[a-z]+|ref)="


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.select(url_cascade.host_of(F.col("url")).alias("key")).where(F.col("key").rlike(LISTED_LABELS)).distinct()
    tracked = pages.where(F.col("url").rlike(TRACKED_LINK)).select(url_cascade.place_of(F.col("url")).alias("key")).distinct()
    return url_cascade.judged(pages, URL_RULES, listed, listed_places=tracked.where("key <> ''"))


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base, stay = F.col("base.label"), F.col("found.label")
    starts = F.col("base.start")

    def written(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        written(base).alias("base_labels"), written(F.concat(base, stay)).alias("labels"), "score",
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), "embedding", 8, 1024.0, keep=["vec_id"])


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_topk, op2_secrets, op3_decontaminate, op4_line_dedup, op5_quality, op6_simhash, op7_langid, op8_warc,
            op9_packing, op10_url_cascade, op11_licenses, op12_whitening, op13_divergence,
        )
    }


def all_sql() -> dict[str, str]:
    """Models, fingerprints, tokenizers and false discovery limits are no SQL; those queries
    are tested against brute force."""
    return {
        "op1_topk": oracle.top_k(),
        "op3_decontaminate": oracle.decontamination(),
        "op4_line_dedup": oracle.line_dedup(),
        "op8_warc": oracle.warc(),
        "op10_url_cascade": oracle.url_cascade(URL_RULES, LISTED_LABELS, TRACKED_LINK),
        "op13_divergence": oracle.divergence(divergence.MIN_DOCS, divergence.TOP_TERMS),
    }
