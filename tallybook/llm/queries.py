"""The contract queries opN_<name>: each runs its operator over the whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import quality
from tallybook.llm.byte_bpe import bpe_decode, bpe_encode
from tallybook.llm.common import documents
from tallybook.llm.embedding_dedup import near_vectors
from tallybook.llm.exact_dedup import exact_dedup
from tallybook.llm.filter_audit import filter_audit
from tallybook.llm.language_id import fit, fold_of, identify
from tallybook.llm.minhash import near_duplicates
from tallybook.llm.mpeg_audio import BLOCK, read_audio, store_as_audio
from tallybook.llm.packing import pack_documents
from tallybook.llm.pseudonyms import KINDS as PII_KINDS
from tallybook.llm.pseudonyms import pseudonymise
from tallybook.llm.secret_scan import KINDS, STRONG, listed, scan_secrets
from tallybook.llm.suffix_dedup import remove_repeats
from tallybook.llm.whitening import whitened_vectors


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda span: span["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, STRONG), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def _any_case(*words: str) -> str:
    """A pattern of the words with ASCII letters in either case; RE2's own folding would take more than ASCII."""
    return "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in words)


def _op1_sql() -> str:
    """The contract's patterns and the weak ones written anew; positions from the gaps between matches; distance decides."""
    secret, assigned = ("password", "passwd", "secret", "token", "api_?key"), "[\"']?\\x20*[:=]\\x20*[\"']?"
    kinds = (  # kind, role, pattern, least length, group that has it; strong ones first
        ("assign", "secret", f"({_any_case(*secret)}){assigned}([A-Za-z0-9+/_.=-]+)", 12, 2),
        ("access", "identifier", "AKIA[A-Z0-9]+", 18, 0),
        ("hex", "secret", "[0-9a-f]+", 16, 0),
        ("identifier", "identifier", f"({_any_case('user', 'username', 'login', 'account', 'client_?id')}){assigned}[A-Za-z0-9_.@-]+|[A-Za-z0-9_.+-]{{1,64}}@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", 1, 0),
        ("endpoint", "endpoint", "[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\\x00-\\x20\"'<>]+", 1, 0),
        ("weak", "secret", f"({_any_case(*secret, 'pwd', 'credentials?')}){assigned}([^\\x00-\\x20\"']+)", 6, 2),
    )

    def rows(rank: int, kind: str, role: str, pattern: str, least: int, group: int) -> str:
        rx = pattern.replace("'", "''")
        return f"""SELECT doc_id, '{role}' AS role, '{kind}' AS kind, {rank} AS rank, s AS start, s + size AS stop FROM (
  SELECT doc_id, length(v) AS value, length(m) AS size,
    CAST(sum(length(g)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS s
  FROM (SELECT doc_id, unnest(string_split_regex(text, '{rx}')) AS g, unnest(regexp_extract_all(text, '{rx}', 0)) AS m,
          unnest(regexp_extract_all(text, '{rx}', {group})) AS v, generate_subscripts(string_split_regex(text, '{rx}'), 1) AS i FROM t)
  WHERE m IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE value >= {least}"""

    parts = " UNION ALL ".join(rows(i, *x) for i, x in enumerate(kinds))
    names = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in ("assign", "access", "hex"))
    text = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), raw AS ({parts}),
parts AS (SELECT * FROM raw w WHERE kind <> 'weak' OR NOT EXISTS (
  SELECT 1 FROM raw a WHERE a.doc_id = w.doc_id AND a.kind = 'assign' AND a.start < w.stop AND w.start < a.stop)),
linked AS (SELECT * FROM parts w WHERE rank < 3 OR EXISTS (
  SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND (w.role = 'secret') <> (p.role = 'secret') AND p.start <= w.stop + 200 AND p.stop >= w.start - 200)),
a AS (SELECT doc_id, {names}, {text} FILTER (rank < 3) AS base, {text} AS spans FROM linked GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("assign", "access", "hex"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN a USING (doc_id)"""


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), percent=85)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return remove_repeats(documents(spark, sf_dir)).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("replaced", lambda span: span["kind"] == kind)).cast("long").alias(f"n_{kind}")

    spans = F.concat_ws(",", F.transform("replaced", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return found.select("doc_id", *map(count, PII_KINDS), (F.size("replaced") > 0).alias("changed"), spans.alias("spans"), "text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP6_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)
"""


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    model = fit(docs.where(fold_of("doc_id", 3) != 1))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir), F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(docs.where(fold_of("doc_id", 4) != 2), labels.where(fold_of("doc_id", 4) != 2))
    return quality.score_quality(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_audio(store_as_audio(documents(spark, sf_dir)))
    payload = F.col("audio.payload")
    rates = F.concat_ws("/", F.transform(F.map_entries("audio.kbps"), lambda e: F.concat_ws("x", e["key"].cast("string"), e["value"].cast("string"))))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            *(F.concat(F.lit(f"{name}="), F.coalesce(value.cast("string"), F.lit(""))) for name, value in (
                ("layer", F.col("audio.layer")), ("hz", F.col("audio.rate")), ("frames", F.col("audio.frames")), ("samples", F.col("audio.samples")), ("ms", F.round(F.col("audio.seconds") * 1000).cast("long")), ("kbps", rates),
                ("checked", F.col("audio.sound")), ("damaged", F.col("audio.damaged")), ("skipped", F.col("audio.skipped")), ("table", F.col("audio.table_frames")), ("seek", F.crc32(F.concat_ws(",", F.col("audio.offsets").cast("array<string>")))),
            )),
        ).alias("feature"),
    )


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe_decode(bpe_encode(documents(spark, sf_dir), vocabulary, public_tokenizers.PATTERN), vocabulary)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_vectors(embeddings(spark, sf_dir), components=16)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP12_SQL = """
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS body, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, [x FOR x IN string_split_regex(body, '[\\x20\\x09-\\x0D]+') IF x <> ''] AS words, min(doc_id) OVER (PARTITION BY body) AS least FROM t),
d AS (
  SELECT part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 10 * length(body) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic
  FROM w),
o(filter_order, used) AS (SELECT '', 0 UNION ALL SELECT filter_order || chr(CAST(65 + i AS INT)), used | (1 << CAST(i AS INT)) FROM o, range(5) r(i) WHERE used & (1 << CAST(i AS INT)) = 0),
s AS (
  SELECT filter_order, CAST(k AS INT) AS step, 1 << (ascii(filter_order[k]) - 65) AS f,
    coalesce(list_sum([1 << (ascii(filter_order[j]) - 65) FOR j IN range(1, k)]), 0)::INT AS b
  FROM o, range(1, 6) q(k) WHERE used = 31),
n AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL)
SELECT part, filter_order, step,
  coalesce(sum(n) FILTER (mask & (f | b) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & b = 0 AND mask & f <> 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & b <> 0 AND mask & f <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = f), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & b = 0 AND mask & f <> 0), 0)::BIGINT AS good_lost,
  coalesce(sum(toxic) FILTER (mask & b = 0 AND mask & f <> 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * (120 // greatest(bit_count(mask), 1))) FILTER (mask & f <> 0), 0)::BIGINT AS shapley
FROM n, s GROUP BY part, filter_order, step
"""


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(embeddings(spark, sf_dir), cosine=0.98)


OP13_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(id, least) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT links.v, least FROM reach JOIN links ON id = u)
SELECT vec_id, (SELECT count(*) FROM links WHERE u = vec_id) AS n_links, component_id, vec_id = component_id AS kept
FROM (SELECT id AS vec_id, min(least) AS component_id FROM reach GROUP BY id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_minhash_dedup, op3_suffix_dedup, op4_pii, op5_packing, op6_exact_dedup, op7_language_id, op8_quality, op9_mpeg_audio, op10_byte_bpe, op11_whitening, op12_filter_audit, op13_near_vectors)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql(), "op6_exact_dedup": OP6_SQL, "op12_filter_audit": OP12_SQL, "op13_near_vectors": OP13_SQL}
