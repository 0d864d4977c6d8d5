"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import removed, stored_at


#: A node of more links than this, and than a thousandth of all links, is a hub; so there are fewer than a thousand hubs.
HUB, HUBS = 1000, 1000


def _starred(links: DataFrame, total: int) -> DataFrame:
    """u, v and least: the least of u and all its v.

    Least nodes are aggregated within each task before the shuffle. Links of hubs take theirs from a broadcast of the
    hubs, which are fewer than HUBS whatever the size of the table, so no task gathers the links of one; the others
    are joined by u.
    """
    nodes = links.groupBy("u").agg(F.least(F.min("v"), "u").alias("least"), F.count(F.lit(1)).alias("links"))
    limit = max(HUB, total // HUBS)
    hubs = nodes.where(F.col("links") > limit).select(F.col("u").alias("hub"), F.col("least").alias("of_hub"))
    marked = links.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left")
    # links of hubs look for nothing, each under a key of its own
    marked = marked.withColumns({"few": F.col("hub").isNull(), "key": F.when(F.col("hub").isNull(), F.col("u")).otherwise(F.xxhash64("u", "v"))})
    others = nodes.where(F.col("links") <= limit).select(F.col("u").alias("node"), "least", F.lit(True).alias("plain"))
    joined = marked.join(others, (F.col("key") == F.col("node")) & (F.col("few") == F.col("plain")), "left")
    return joined.select("u", "v", F.coalesce("of_hub", "least").alias("least"))


def _is_forest_of_stars(links: DataFrame) -> bool:
    """Every u has one v, and no v is a u: then v is the component."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(links.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return ends.groupBy("id").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 OR child > 0 AND parent > 0").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """id and component (the smallest id that can be reached) of all ids in edges, a table of two long columns u, v.

    Nulls and loops are left out. Each round links every node to the least of its neighbours, until all links lead
    straight to a component's least node. Every round is written to the shared folder and takes the place of the one
    before. An empty edge table gives an empty result.
    """
    links = edges.na.drop().where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    spark = edges.sparkSession
    links, at = stored_at(links)
    while not _is_forest_of_stars(links):
        total = 2 * links.count()
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        links = _starred(both, total).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        small = _starred(links, total)
        links = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        links, after = stored_at(links)
        removed(spark, at)
        at = after
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
