"""Entity and relation aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.common import stored


def entity_counts(mentions: DataFrame) -> DataFrame:
    """A6 from (doc, pos, name, label): (name, label of the first mention, mentions, docs). Aggregates map-side."""
    per = mentions.groupBy("name", "doc").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "pos", "label")).alias("f"))
    return per.groupBy("name").agg(F.min("f").alias("f"), F.sum("n").alias("mentions"), F.count(F.lit(1)).alias("docs")).select("name", F.col("f.label").alias("label"), "mentions", "docs")


def relation_counts(triples: DataFrame, n: int = 100) -> DataFrame:
    """The n most frequent triples, ties by text."""
    return triples.groupBy("subject", "predicate", "object").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "subject", "predicate", "object").limit(n)


def resolve(entities: DataFrame) -> DataFrame:
    """Names folded into the first canonical name of the same label that contains them or lies in them, case aside, by falling count.

    Containments come from a join of the names with the pieces of all names. A name is canonical once all earlier
    names it meets are known not to be, and an alias once one of them is; rounds end when all names are decided."""
    names = stored(entities.select("label", "name", "mentions", F.lower(F.trim("name")).alias("low")), "names")
    sizes = sorted(r[0] for r in names.where("low IS NOT NULL").select(F.length("low")).distinct().collect())
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.length("low") - k + 1), lambda i: F.substr("low", i, F.lit(k)))
    pieces = F.array_distinct(F.flatten(F.array(*[F.when(F.length("low") >= k, cut(k)).otherwise(F.array().cast("array<string>")) for k in sizes or [0]])))
    big = names.select(F.col("label").alias("l"), F.struct((-F.col("mentions")).alias("m"), "name").alias("a"), F.explode(pieces).alias("piece"))
    meet = big.join(names, F.col("l").eqNullSafe(F.col("label")) & (F.col("piece") == F.col("low"))).select("label", "a", F.struct((-F.col("mentions")).alias("m"), "name").alias("b")).where("a.name <> b.name")
    meet = stored(meet.select("label", F.least("a", "b").alias("first"), F.greatest("a", "b").alias("then")).distinct(), "meet")
    same = lambda x, y: F.col(x + ".label").eqNullSafe(F.col(y + ".label"))
    ends = meet.select("label", F.col("first.name").alias("name")).union(meet.select("label", "then.name")).distinct()
    state = stored(ends.withColumn("s", F.lit(0)), "state")  # 0 undecided, 1 canonical, 2 alias
    while not state.where("s = 0").isEmpty():
        near = meet.alias("e").join(state.alias("x"), same("e", "x") & (F.col("e.first.name") == F.col("x.name"))).groupBy("e.label", F.col("e.then.name").alias("name")).agg(F.max((F.col("s") == 1).cast("int")).alias("hit"), F.max((F.col("s") == 0).cast("int")).alias("open"))
        new = F.when(F.col("s") > 0, F.col("s")).when(F.col("hit") == 1, 2).when(F.coalesce("open", F.lit(0)) == 0, 1).otherwise(0)
        state = stored(state.alias("x").join(near.alias("n"), same("x", "n") & (F.col("x.name") == F.col("n.name")), "left").select("x.label", "x.name", new.alias("s")), "state")
    canon = meet.alias("e").join(state.where("s = 1").alias("x"), same("e", "x") & (F.col("e.first.name") == F.col("x.name"))).groupBy("e.label", F.col("e.then.name").alias("name")).agg(F.min("e.first").alias("c"))
    out = names.alias("n").join(canon.alias("c"), same("n", "c") & (F.col("n.name") == F.col("c.name")), "left")
    return out.select("n.label", "n.name", F.coalesce("c.c.name", "n.name").alias("canonical"), "n.mentions")


def evidence(paras: DataFrame, names: list[str], least: int = 2, n: int = 50) -> DataFrame:
    """Paragraphs that hold at least ``least`` of the names (at most twenty), case aside, the n richest first."""
    low = F.lower("para")
    hits = sum((low.contains(x).cast("int") for x in {n.lower() for n in names}), F.lit(0))
    return paras.where(F.length("para") > 80).withColumn("hits", hits).where(F.col("hits") >= least).orderBy(F.desc("hits"), "file_id", "para_ord").limit(n).select("file_id", "para_ord", "hits", F.substring("para", 1, 500).alias("para"))
