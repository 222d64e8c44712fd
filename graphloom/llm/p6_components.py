"""Problem 6: one group identifier for everything linked directly or indirectly.

Hash-to-min, kept relational: the cluster set of a vertex is a set of rows
(vertex, member).  In each round a vertex sends its set to its smallest member
and the smallest member to all others; both are rows again, so a hub or a giant
group is spread over all tasks by the hash of (vertex, member) and never becomes
one value.  The smallest member is a partial aggregate; attaching it is a join
whose hot keys are salted.  Rounds grow with the logarithm of the diameter.

Edge cases: rows with a NULL or blank end and self links are no links; repeated
and reversed links count once; ids are trimmed; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.runtime import checkpoint

SALTS = 32
#: Rows of one vertex from which they are salted.
HOT = 50_000
ROUNDS = 60


def _with_min(sets: DataFrame) -> DataFrame:
    """(v, u, m): each member row with the smallest member of its vertex."""
    least = sets.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n"))
    least = least.withColumn("s", F.explode(F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    hot = least.where((F.col("n") > HOT) & (F.col("s") == 0)).select("v", F.lit(SALTS).alias("k"))
    salted = sets.join(hot, "v", "left").withColumn("s", F.when(F.col("k").isNull(), 0).otherwise(F.pmod(F.hash("u"), F.lit(SALTS))))
    return salted.join(least.select("v", "s", "m"), ["v", "s"]).select("v", "u", "m")


def _round(sets: DataFrame) -> DataFrame:
    seen = _with_min(sets)
    return seen.select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.*").distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, group_id): every id of ``pairs`` with the smallest id of its group.

    ``pairs`` may hold either direction, both, repeats; rows with a NULL end or
    equal ends are ignored.
    """
    links = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null and v <> u")
    sets = links.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))).alias("e")).select("e.*").distinct()
    mark = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    sets = checkpoint(sets)
    before = mark(sets)
    for _ in range(ROUNDS):
        sets = checkpoint(_round(sets))
        now = mark(sets)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("hash-to-min did not settle")
    return sets.groupBy(F.col("v").alias("id")).agg(F.min("u").alias("group_id"))


def norm_type(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[\s_]+", ""))


def match_groups(links: DataFrame, source: str = "source_id", target: str = "target_id", rel_type: str = "rel_type", kind: str = "relatedto") -> DataFrame:
    """(id, group_id) over the rows of ``links`` whose type, written in any way, is ``kind``."""
    clean = lambda c: F.regexp_replace(F.col(c), r"^\s+|\s+$", "")
    pairs = links.where(norm_type(F.col(rel_type)) == kind).select(clean(source).alias("a"), clean(target).alias("b"))
    return components(pairs.where("a <> '' and b <> ''"), "a", "b")
