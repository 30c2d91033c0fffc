"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floorledger.llm.common import staged, whole_rows


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def content_hash(text: Column) -> Column:
    """128 bits, as 16 bytes."""
    return F.unhex(F.md5(text))


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are equal when their normalised texts are. Grouping by (hash, text) compares the bytes of every
    text under a hash, and folds copies before the shuffle, so a group of any size sends one row per
    task. Only if a hash holds two texts are the rows of that hash also joined on their text.

    Null and empty texts are one group. The smallest id is kept; null ids come last, and a group with
    null ids only has a null ``keep_id`` and keeps all its rows. A repeated row (same id, same text) is
    a copy with the same id, so each of them counts in ``group_size`` and is kept. Other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content")))
    members = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    texts = rows.groupBy("digest", "content").agg(*members)
    groups = staged(
        texts.select("digest", F.sha2("content", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    collided = groups.groupBy("digest").count().filter("count > 1").select("digest")
    plain = rows.select("doc_id", "digest").join(groups, "digest")
    if collided.isEmpty():
        found = plain
    else:
        collided = staged(collided)
        apart = rows.join(collided, "digest", "left_semi")
        exact = apart.groupBy("digest", "content").agg(*members)
        exact = exact.withColumn("text_sha256", F.sha2("content", 256))
        found = plain.join(collided, "digest", "left_anti").unionByName(
            apart.join(exact, ["digest", "content"]).drop("content")
        )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one per group, with their columns unchanged, whatever they are called."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept")
    kept = staged(kept.groupBy(F.col("keep_id").alias("kept_id"), "text_sha256").agg(F.count(F.lit(1)).alias("copies")))
    content = F.sha2(normalised(F.col(text_col)), 256)
    marked = docs.select(whole_rows(docs), F.col(id_col).alias("id"), content.alias("content"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("content") == F.col("text_sha256"))
    out = marked.join(kept, same, "left_semi")
    if not kept.filter("copies > 1").isEmpty():  # ids repeat
        out = out.dropDuplicates(["id", "content"])
    return out.select("row.*")
