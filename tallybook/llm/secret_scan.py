"""Secret scanning with multipart credential linking, in DataFrame operations only.

Strong patterns are reported wherever they match. Weak ones (short or odd secrets, account names, endpoints) are
reported only where a complementary part lies close by: a secret needs an identifier or an endpoint, an identifier or
endpoint needs a secret. The search for complementary parts is an interval join within scopes: a scope is a stretch of
REACH characters of one document, and a part is in every scope that it touches, so it only has to meet what its own
scopes and those adjacent to them hold, of which the outermost positions suffice.

One scan matches the patterns and gives a narrow row for each match; positions are running sums of the gaps between a
document's matches, so that a document with very many matches costs no more for each. These rows are checkpointed, and
what follows reads them instead of the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import besides, checkpointed, quoted, unused

#: Characters allowed between complementary parts.
REACH = 200
#: Code points of the pieces in which a text is masked.
PIECE = 4096

KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
VALUE = "[\"']?\\x20*[:=]\\x20*[\"']?"
#: kind -> (role, pattern, texts of which a document must have one, in any case, for the pattern to be tried, least length, group that has it)
STRONG = {
    "assign": ("secret", f"(?i:password|passwd|secret|token|api_?key){VALUE}([A-Za-z0-9+/_.=-]+)", KEYWORDS, 12, 1),
    "access": ("identifier", "AKIA[A-Z0-9]+", ("akia",), 18, 0),
    "hex": ("secret", "[0-9a-f]{16,}", (), 16, 0),
}
#: Repeated groups are possessive, as Java's matcher would otherwise need stack for each repetition.
WEAK = {
    "identifier": ("identifier", f"(?i:user|username|login|account|client_?id){VALUE}[A-Za-z0-9_.@-]+|[A-Za-z0-9_.+-]{{1,64}}@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)++", ("user", "login", "account", "clientid", "client_id", "@"), 1, 0),
    "endpoint": ("endpoint", "[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\\x00-\\x20\"'<>]+", ("://",), 1, 0),
    "weak": ("secret", f"(?i:password|passwd|secret|token|api_?key|pwd|credentials?){VALUE}([^\\x00-\\x20\"']+)", (*KEYWORDS, "pwd", "credential"), 6, 1),
}
#: Kinds in the order in which spans of the same start are listed.
KINDS = [*STRONG, *WEAK]
SPAN = "array<struct<start:int,rank:int,end:int>>"
MATCH = "array<struct<rank:int,number:int,gap:int,size:int,counts:boolean>>"


def matches_of(text: Column, lowered: Column, kind: str) -> Column:
    """The leftmost non-overlapping matches of a kind: characters since the one before, length, and if it is long enough.

    The gaps between matches come from split and the matches from regexp_extract_all. What follows the last match is a
    gap of its own, of null size.
    """
    _, pattern, hints, least, group = (STRONG | WEAK)[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    sized = F.zip_with(found, values, lambda m, v: F.struct(F.length(m).alias("size"), (F.length(v) >= least).alias("counts")))
    paired = F.zip_with(F.split(text, pattern, -1), sized, lambda gap, m: F.struct(F.length(gap).alias("gap"), m.alias("match")))
    steps = F.transform(paired, lambda x, i: F.struct(F.lit(KINDS.index(kind)).alias("rank"), i.alias("number"), x["gap"].alias("gap"), x["match"]["size"].alias("size"), x["match"]["counts"].alias("counts")))
    none = F.array().cast(MATCH)
    some = F.when(text.rlike(pattern), steps).otherwise(none)
    if not hints:
        return some
    hinted = F.lit(False)
    for hint in hints:
        hinted = hinted | lowered.contains(hint)
    return F.when(hinted, some).otherwise(none)


def row_key(id_col: str, text_col: str) -> Column:
    """Rows are told apart by id and text: repeated rows share a key, rows of null id have keys of their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text).cast("string"), F.crc32(text.cast("binary")).cast("string"), F.octet_length(text).cast("string"))


def parts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, rank, start and end of all matches that are long enough; weak secrets that an assignment overlaps are left out.

    Repeated rows are merged before the shuffle. Both windows run within one document's matches.
    """
    rows = docs.select(row_key(id_col, text_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("lowered", F.lower("text"))
    found = rows.select("key", F.explode(F.concat(*(matches_of(F.col("text"), F.col("lowered"), kind) for kind in KINDS))).alias("m")).select("key", "m.*")
    found = found.where("size is not null").groupBy("key", "rank", "number").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("counts").alias("counts"))
    upto = Window.partitionBy("key", "rank").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto).cast("int")).where("counts")
    parts = ended.select("key", "rank", (F.col("end") - F.col("size")).alias("start"), "end")
    # an assignment overlaps a weak secret if, of those that start before its end, the last one ends after its start
    weak, assign = F.col("rank") == KINDS.index("weak"), F.col("rank") == KINDS.index("assign")
    before = Window.partitionBy("key").orderBy(F.when(weak, F.col("end")).otherwise(F.col("start")), F.when(weak, 0).otherwise(1), "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = F.max(F.when(assign, F.col("end"))).over(before)
    return parts.withColumn("reached", reached).where(~weak | F.col("reached").isNull() | (F.col("reached") <= F.col("start"))).drop("reached")


def linked_parts(parts: DataFrame) -> DataFrame:
    """The weak parts that have a complementary part of their document within REACH.

    Parts are in every scope from start to end; per key, scope and role only the smallest start and the largest end are
    joined, so a scope that is full of parts costs no more than one that has one of each. The two suffice: parts that
    lie on either side of another, both out of reach, never touch one scope.
    """
    role_of = F.element_at(F.array(*(F.lit((STRONG | WEAK)[kind][0]) for kind in KINDS)), F.col("rank") + 1)
    first, last = (F.floor(F.col(at) / REACH) for at in ("start", "end"))
    placed = parts.select("key", "rank", "start", "end", role_of.alias("role"), F.explode(F.sequence(first, last)).alias("scope"))
    edges = (
        placed.groupBy("key", "scope", "role")
        .agg(F.min("start").alias("least"), F.max("end").alias("most"))
        .select("key", F.explode(F.array(*(F.col("scope") + d for d in (-1, 0, 1)))).alias("scope"), F.col("role").alias("other"), "least", "most")
    )
    complementary = ((F.col("role") == "secret") & F.col("other").isin("identifier", "endpoint")) | ((F.col("role") != "secret") & (F.col("other") == "secret"))
    close = (F.col("least") <= F.col("end") + REACH) & (F.col("most") >= F.col("start") - REACH)
    hits = placed.where(F.col("rank") >= len(STRONG)).join(edges, ["key", "scope"]).where(complementary & close)
    return hits.select("key", "rank", "start", "end").distinct()


def reported(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, rank, start and end of all strong parts and of the linked weak ones."""
    parts = checkpointed(parts_of(docs, id_col, text_col))
    return parts.where(F.col("rank") < len(STRONG)).unionByName(linked_parts(parts))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with base and spans: arrays of (start, rank, end) in code points, in order; rank: of KINDS.

    base has the strong matches, spans those and the linked weak ones. Columns named base or spans, in either letter
    case, are replaced; other names are free. Null and empty texts give empty arrays. Rows are told apart by id and
    text, so repeated rows get equal results and rows of null id their own. An empty table gives an empty result.
    """
    span = F.struct("start", "rank", "end")
    listed = F.collect_list(span)
    strong = F.collect_list(F.when(F.col("rank") < len(STRONG), span))
    key, base, spans = unused(docs, "key", "base_spans", "all_spans")
    found = reported(docs, id_col, text_col).groupBy(F.col("key").alias(key)).agg(F.array_sort(strong).alias(base), F.array_sort(listed).alias(spans))
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(found, key, "left")
    none = F.array().cast(SPAN)
    return joined.select(*quoted(besides(docs, "base", "spans")), F.coalesce(base, none).alias("base"), F.coalesce(spans, none).alias("spans"))


def listed(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def masked(piece: Column, number: Column, spans: Column, mark: str) -> Column:
    """A piece of a text without the spans that touch it; a mark where a span begins that no earlier one overlaps."""
    begin = number * PIECE

    def step(acc: Column, s: Column) -> Column:
        start, end = s["start"] - begin, F.least(s["end"] - begin, F.lit(PIECE))
        fresh = (start >= acc["at"]) & (start >= 0)
        out = F.when(fresh, F.concat(acc["out"], F.substring(piece, acc["at"] + 1, start - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], end).alias("at"), out.alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda acc: F.concat(acc["out"], F.substring(piece, acc["at"] + 1, F.lit(PIECE))))


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of scan_secrets replaced by mark; overlapping spans become one mark. No row is dropped.

    Texts are masked in pieces of PIECE code points, each with the spans that touch it, so the work grows with text and
    spans alone. Null and empty texts stay; repeated rows and rows of null id are masked alike; columns of any name stay.
    """
    last = F.floor((F.col("end") - 1) / PIECE).cast("int")
    placed = reported(docs, id_col, text_col).withColumn("number", F.explode(F.sequence(F.floor(F.col("start") / PIECE).cast("int"), last)))
    by_piece = placed.groupBy("key", "number").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))
    key, pieces, text = unused(docs, "key", "pieces", "whole")
    found = by_piece.groupBy(F.col("key").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("number", "spans"))).alias(pieces))
    joined = docs.withColumns({key: row_key(id_col, text_col), text: F.col(text_col)}).join(found, key, "left")
    cut = F.transform(F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda piece, i: F.when(F.map_contains_key(pieces, i), masked(piece, i, F.element_at(pieces, i), mark)).otherwise(piece))
    clean = F.when(F.col(pieces).isNull(), F.col(text)).otherwise(F.array_join(cut, ""))
    return joined.select(*(clean.alias(c) if c.lower() == text_col.lower() else q for c, q in zip(docs.columns, quoted(docs.columns), strict=True)))
