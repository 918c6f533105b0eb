"""Exact deduplication in three steps that no hot text can overload: local, salted, global."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import cut, each_salt, fresh, salts_of, text_of

#: Sub-groups into which the copies of one text are dealt. A group with a third of all rows puts 1/192 of them in one.
SALTS = 64


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Copies are first combined within each map task, then per (digest, salt), then the salts' winners per digest. Each
    step groups by the text itself beside the digest, so that equal digests of different texts never merge. Only the
    ids travel back to the rows, along (digest, salt); were two texts to share a digest, the texts travel as well.

    Null texts count as empty. The largest id of a group stays; a null id ranks below all others. Rows that repeat the
    staying id and text are the same document and are all marked kept. An empty table gives an empty result; columns
    other than the two are ignored, so their names may clash with nothing.
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text")).select(
        "__id", "__text", digest(F.col("__text")).alias("__digest"), F.pmod(F.xxhash64("__id"), F.lit(salts)).cast("int").alias("__salt")
    )
    local = rows.groupBy("__digest", "__salt", "__text").agg(F.max("__id").alias("__keep"), F.count(F.lit(1)).alias("__n"))
    merged = local.repartition("__digest").groupBy("__digest", "__text").agg(F.max("__keep").alias("keep_id"), F.sum("__n").alias("group_size"), salts_of("__salt").alias("__salts"))
    groups = cut(merged.select("__digest", F.sha2("__text", 256).alias("text_sha256"), "keep_id", "group_size", "__salts"))
    on = ["__digest", "__salt"]
    if groups.groupBy("__digest").count().where("count > 1").isEmpty():
        found = groups.withColumn("__salt", each_salt("__salts"))
    else:
        on.append("__text")
        found = merged.withColumn("text_sha256", F.sha2("__text", 256)).withColumn("__salt", each_salt("__salts"))
    out = rows.select("__id", *on).join(found.drop("__salts"), on)
    return out.select(F.col("__id").alias(id_col), "keep_id", "group_size", F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of ``docs`` for each text, that with the largest id; all columns stay. Of rows that repeat id and text, any one."""
    groups = exact_groups(docs, id_col, text_col, **how)
    who, what, text = (fresh(docs, x) for x in ("__gone", "__digest", "__text"))
    gone = groups.where("NOT kept").select(F.col(id_col).alias(who), F.col("text_sha256").alias(what))
    repeated = groups.where("kept").groupBy(id_col, "text_sha256").count().where("count > 1")
    same = F.col(id_col).eqNullSafe(F.col(who)) & (F.sha2(text_of(text_col), 256) == F.col(what))
    out = docs.join(gone.distinct(), same, "left_anti")
    if repeated.isEmpty():
        return out
    return out.withColumn(text, text_of(text_col)).dropDuplicates([id_col, text]).select(*docs.columns)
