"""The registered queries of the operators, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorledger.llm.common import table
from floorledger.llm.embedding_itq import near_vectors
from floorledger.llm.exact_dedup import exact_dedup
from floorledger.llm.language_id import identify_languages
from floorledger.llm.minhash_dedup import near_dedup
from floorledger.llm.mixing import mix
from floorledger.llm.packing import pack
from floorledger.llm.prefix_trie import conversation_trie
from floorledger.llm.quality_fm import quality
from floorledger.llm.sharding import shard_documents
from floorledger.llm.spelling_trie import spelling_variants
from floorledger.llm.substring_automata import substring_dedup
from floorledger.llm.toxicity_crf import toxicity
from floorledger.llm.url_filter import Rule, url_filter

SEQUENCE_TOKENS = 2048
SHARDS = 40
MAX_REPEATS = 2.0
URL_RULES = [
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
]


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language_bitmask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op2_balanced_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), SHARDS)


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.3)


def op4_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path(), SEQUENCE_TOKENS)


def op5_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), cut=0.5)


def op6_itq_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), percent=85)


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), max_repeats=MAX_REPEATS)


def op11_spelling_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_prefix_unionfind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_bitmask,
        op2_balanced_labels,
        op3_quality_fm,
        op4_best_two_fit,
        op5_toxicity_crf,
        op6_itq_embeddings,
        op7_url_filter,
        op8_exact_dedup,
        op9_minhash_dedup,
        op10_temperature_mix,
        op11_spelling_frontier,
        op12_suffix_automata,
        op13_prefix_unionfind,
    )
}

ORACLE = {
    "op8_exact_dedup": r"""
WITH rows AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS content
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, text_sha256
FROM rows WINDOW same AS (PARTITION BY content)""",
}
