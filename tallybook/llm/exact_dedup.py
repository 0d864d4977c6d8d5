"""Exact deduplication by a 128-bit content hash, with a comparison of the bytes inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import id_and_text, quoted, single_spaced, unused


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group documents of equal text (white-space runs count as one space); the smallest id of a group stays.

    Returns one row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    The grouping key is the MD5 of the normalised text followed by the text itself, so rows whose hashes collide but
    whose bytes differ fall into different groups. Equal texts are merged before the shuffle, within each task, so a
    text that makes up a third of the table reaches the shuffle once per task. Rows find their group by both digests;
    they are narrow, and adaptive execution splits a hot digest on their side of the join.

    Null texts count as empty; empty texts are equal to each other. Rows of null id form groups like any other: a
    group's keep_id is its smallest non-null id, and a row of null id is never kept. Repeated rows (same id and text)
    count separately in group_size and share the decision. An empty table gives an empty result.
    """
    rows = id_and_text(docs, id_col, text_col).select("doc_id", single_spaced(F.col("text")).alias("body"))
    digest = F.unhex(F.md5("body")).alias("digest")
    groups = (
        rows.select("doc_id", digest, "body")
        .groupBy("digest", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("digest", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    return (
        rows.select("doc_id", digest, F.sha2("body", 256).alias("text_sha256"))
        .join(groups, ["digest", "text_sha256"])
        .select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of exact_dedup, with all its columns: one of the smallest id, of null id if there is no other.

    Rows are chosen, not ids: repeated rows collapse to one, rows of null id stay if their text has no row with an id,
    and rows that share an id but not the text are judged apart. Of rows that share id and text, a hash of all columns
    decides. Each task sends one row of a group to the shuffle at most.
    """
    body, digest, row_hash, place = unused(docs, "body", "digest", "row_hash", "place")
    hashed = F.xxhash64(*quoted([c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]))
    best = Window.partitionBy(digest, body).orderBy(F.col(id_col).cast("long").asc_nulls_last(), F.col(row_hash))
    rows = docs.withColumns({body: single_spaced(F.coalesce(F.col(text_col), F.lit(""))), row_hash: hashed}).withColumn(digest, F.unhex(F.md5(F.col(body))))
    return rows.withColumn(place, F.row_number().over(best)).where(F.col(place) == 1).select(*quoted(docs.columns))
