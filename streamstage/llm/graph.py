"""Connected components of a graph in a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamstage.llm.common import cut, each_salt, salts_of

#: Sub-groups into which a node's edges are dealt.
SALTS = 32


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b): the smallest node that can be reached.

    Large-star and small-star steps in turn, each a few joins on nodes; edges only ever move to smaller nodes, so that
    after some rounds (logarithmic in practice) each edge leads from a node straight to its component.
    """
    now = cut(_large_star(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    mark = _mark(now)
    while mark[0]:
        now = cut(_large_star(_small_star(now)))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first())


def _with_least(edges: DataFrame) -> DataFrame:
    """The edges with m, the smallest b of their a. The edges of a hub are dealt by salts of b, in the grouping as in the
    way back, so that none of its tasks holds all of them."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    part = salted.groupBy("a", "salt").agg(F.min("b").alias("m"))
    whole = part.groupBy("a").agg(F.min("m").alias("m"), salts_of("salt").alias("salts"))
    return salted.join(whole.select("a", "m", each_salt("salts").alias("salt")), ["a", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the smallest neighbour of it (or to itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the smallest of them."""
    known = _with_least(edges)
    return known.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
