"""Exact deduplication by a heavy-hitter split.

A Misra-Gries sketch (Spark's ``approx_top_k``, the frequent-items variant that decrements by
the median counter) names digests that may be frequent. Their exact sizes and winners are
verified, broadcast, and take the frequent rows out before any shuffle. The other digests, each
of which holds a small share of the rows by the sketch's guarantee, go through one shuffle.

Defined results: null text counts as empty; null ids rank below all others; of rows with equal
text and equal id one stays; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixspark.llm.text import ascii_lower, named, utf8, whole
from helixspark.session import cut, table

#: The broadcast holds at most so many digests of 32 bytes each.
MAX_HEAVY = 2000
#: Counters in the sketch: a digest with over rows / (0.75 * TRACKED) rows is always among them.
TRACKED = 16384


def digest(text: Column) -> Column:
    """SHA-256 of the text with A-Z lower-cased, 32 bytes."""
    return F.unhex(F.sha2(ascii_lower(utf8(text)), 256))


def _ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return cut(docs.select(named(id_col).alias("doc_id"), digest(named(text_col)).alias("digest"), F.monotonically_increasing_id().alias("row")))


def heavy_winners(ids: DataFrame, max_heavy: int = MAX_HEAVY, tracked: int = TRACKED) -> DataFrame:
    """digest, group_size and winner (doc_id, row) of the frequent digests; ``max_heavy`` rows at most."""
    named = ids.agg(F.expr(f"approx_top_k(hex(digest), {max_heavy}, {tracked})").alias("top")).select(F.inline("top"))
    named = named.select(F.unhex("item").alias("digest"))
    found = ids.join(F.broadcast(named), "digest").groupBy("digest")
    winners = found.agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("winner"))
    return cut(winners.where("group_size > 1"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY, tracked: int = TRACKED) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    ids = _ids(docs, id_col, text_col)
    winners = heavy_winners(ids, max_heavy, tracked)
    heavy = ids.join(F.broadcast(winners), "digest")
    light = ids.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    sizes = light.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("winner"))
    light = light.join(sizes, "digest")
    return heavy.select(light.columns).unionByName(light).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_heavy: int = MAX_HEAVY, tracked: int = TRACKED) -> DataFrame:
    """The documents, whole, without all but one of those with equal texts.

    Frequent copies fall on the map side; of the rest whole rows are shuffled once, by digest.
    """
    winners = heavy_winners(_ids(docs, id_col, text_col), max_heavy, tracked)
    rows = docs.select(whole(docs).alias("doc"), named(id_col).alias("id"), digest(named(text_col)).alias("digest"))
    best = F.row_number().over(W.partitionBy("digest").orderBy(F.col("id").desc_nulls_last()))
    heavy = rows.join(F.broadcast(winners.select("digest", F.col("winner.doc_id").alias("keep"))), "digest").where(F.col("id").eqNullSafe(F.col("keep"))).drop("keep")
    light = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    return heavy.select(light.columns).unionByName(light).withColumn("best", best).where("best = 1").select("doc.*")


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents),
     g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
