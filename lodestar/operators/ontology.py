"""Validation and the inference rules of functional and typed properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.plans.lineage import cut

#: Property, least and most values of a project.
CARDINALITY = (("ISSUED_BY", 1, 1), ("HAS_BUDGET", 0, 1), ("HAS_PERIOD", 0, 1))
#: Property, class of its subject, class of its object.
TYPES = (("ISSUED_BY", "project", "agency"), ("REQUIRES", "project", "tech"), ("HAS_BUDGET", "project", "budget"), ("HAS_PERIOD", "project", "period"))


def cardinality_violations(relations: DataFrame, rules=CARDINALITY) -> DataFrame:
    """(focus, path, n) of subjects whose number of distinct values breaks a rule, by one aggregation."""
    counts = [F.countDistinct(F.when(F.col("rtype") == p, F.col("tail"))).alias(p) for p, _, _ in rules]
    wide = relations.groupBy(F.col("head").alias("focus")).agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("path"), F.col(p).alias("n"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for p, lo, hi in rules])).alias("r")
    return wide.select("focus", rows).where("r.n < r.lo or r.n > r.hi").select("focus", "r.path", "r.n")


def inferred_types(relations: DataFrame, types=TYPES) -> DataFrame:
    """(eid, class) that the domains and ranges of properties imply."""
    table = relations.sparkSession.createDataFrame(list(types), "rtype string, domain string, range string")
    met = relations.join(F.broadcast(table), "rtype")  # one row a property
    pair = F.explode(F.array(F.struct(F.col("head").alias("eid"), F.col("domain").alias("class")), F.struct(F.col("tail").alias("eid"), F.col("range").alias("class")))).alias("t")
    return met.select(pair).select("t.*").distinct()


def type_report(entities: DataFrame, types: DataFrame) -> DataFrame:
    """(status, n) of entities (eid): typed as their id's prefix says, otherwise, or not at all."""
    kind = F.split("eid", ":")[0]
    rows = entities.select("eid").distinct().join(types, "eid", "left")
    status = F.when(F.col("class").isNull(), "untyped").when(F.col("class") == kind, "agrees").otherwise(F.lit("differs"))
    return rows.withColumn("status", status).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def disjoint_violations(types: DataFrame) -> DataFrame:
    """Entities of more than one of the (disjoint) classes."""
    return types.groupBy("eid").agg(F.array_sort(F.collect_set("class")).alias("classes")).where(F.size("classes") > 1)


def same_as(relations: DataFrame, functional: tuple[str, ...] = ("ISSUED_BY", "HAS_BUDGET", "HAS_PERIOD")) -> DataFrame:
    """(a, b), a < b: distinct values of one functional property of one subject are the same.

    Each value is tied to the smallest of its group, so a group of n values
    gives n - 1 pairs; ``closure`` has the rest.
    """
    values = relations.where(F.col("rtype").isin(*functional)).select("head", "rtype", "tail").distinct()
    least = values.groupBy("head", "rtype").agg(F.min("tail").alias("a"))
    return values.join(least, ["head", "rtype"]).where("tail <> a").select("a", F.col("tail").alias("b")).distinct()


def closure(pairs: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(eid, same): the smallest member of each entity's class under the symmetric, transitive closure.

    Labels spread to neighbours and then jump to the label of their label, so a
    long chain settles in about the logarithm of its length; it is an error if
    they have not settled after ``most_rounds``.
    """
    edges = cut(pairs.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.*").distinct())
    labels = edges.groupBy(F.col("u").alias("eid")).agg(F.least(F.col("eid"), F.min("v")).alias("same"))
    for _ in range(most_rounds):
        near = edges.join(labels.select(F.col("eid").alias("v"), "same"), "v").groupBy(F.col("u").alias("eid")).agg(F.min("same").alias("near"))
        spread = labels.join(near, "eid").select("eid", F.col("same").alias("old"), F.least("same", "near").alias("same"))
        jump = labels.select(F.col("eid").alias("same"), F.col("same").alias("far"))
        labels = cut(spread.join(jump, "same").select("eid", F.least("same", "far").alias("same"), (F.least("same", "far") < F.col("old")).alias("moved")))
        moved = labels.where("moved").limit(1).count()
        labels = labels.select("eid", "same")
        if not moved:
            break
    else:
        raise RuntimeError("classes did not settle")
    return labels


def substitute(relations: DataFrame, same: DataFrame) -> DataFrame:
    """Relations with every entity replaced by the smallest of its class, once each."""
    h, t = same.select(F.col("eid").alias("head"), F.col("same").alias("h")), same.select(F.col("eid").alias("tail"), F.col("same").alias("t"))
    return relations.join(h, "head", "left").join(t, "tail", "left").select(F.coalesce("h", "head").alias("head"), "rtype", F.coalesce("t", "tail").alias("tail")).distinct()


def saturate(relations: DataFrame, functional: tuple[str, ...] = ("ISSUED_BY", "HAS_BUDGET", "HAS_PERIOD"), most_rounds: int = 50) -> tuple[DataFrame, DataFrame]:
    """(relations, same): functional properties, equality and substitution carried to their joint fixpoint.

    ``same`` is (eid, same) of all entities that equal another, with the smallest of their
    class; the relations name these only. Substitution can give a subject two
    values that it didn't have, which are then equal too, and so on. A
    round looks only at subjects of relations that the round before changed, and
    changes only relations that name an entity which moved. It is an error if
    there is no end after ``most_rounds``.
    """
    facts = cut(relations.select("head", "rtype", "tail").distinct())
    fresh, same = facts, None
    for _ in range(most_rounds):
        touched = fresh.where(F.col("rtype").isin(*functional)).select("head", "rtype").distinct()
        pairs = cut(same_as(facts.join(touched, ["head", "rtype"], "left_semi"), functional))
        if not pairs.limit(1).count():
            break
        moved = cut(closure(pairs).where("eid <> same"))
        if same is None:
            same = moved
        else:
            on = moved.select(F.col("eid").alias("was"), F.col("same").alias("now"))
            same = cut(same.join(on, F.col("same") == F.col("was"), "left").select("eid", F.coalesce("now", "same").alias("same")).unionByName(moved))
        h, t = (moved.select(F.col("eid").alias(c), F.col("same").alias(n)) for c, n in (("head", "h"), ("tail", "t")))
        met = cut(facts.join(h, "head", "left").join(t, "tail", "left"))
        fresh = cut(met.where("h is not null or t is not null").select(F.coalesce("h", "head").alias("head"), "rtype", F.coalesce("t", "tail").alias("tail")).distinct())
        facts = cut(met.where("h is null and t is null").select("head", "rtype", "tail").unionByName(fresh).distinct())
    else:
        raise RuntimeError("the rules did not settle")
    if same is None:
        return facts, relations.select(F.col("head").alias("eid"), F.col("head").alias("same")).where("false")
    return facts, same.unionByName(same.select(F.col("same").alias("eid"), "same").distinct())


def inconsistencies(pairs: DataFrame, kind: str = "agency") -> DataFrame:
    """Pairs inferred to be the same although entities of their kind all differ."""
    of = lambda c: F.split(F.col(c), ":")[0] == kind
    return pairs.where(of("a") & of("b"))
