"""Mixing sources to target weights: per-source token totals, repetition rates, and hash-seeded copies of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumiframe.llm.common import materialize, words

#: No source is taken more often than this; weights repeat over the sources in order of code points, null last.
MOST_REPEATS, WEIGHTS, SEED = 3, (1, 2, 3), "mix"


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """source, source_size, target of a table (source, size): shares of all tokens by weight, each at most `most` times its source.

    What a source can't take is shared among the others by weight until none is above its limit. In closed form:
    with the sources in order of limit/weight, the first i are at their limit and the others get level x weight, for
    the first level that no next source's limit is below. An empty table gives no row; a source without tokens gets 0.
    The table of sources has a row per source, and its windows put them in one task: meant for up to some millions of
    sources, whatever the documents count.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    # in UTF-8, Spark's order of strings is that of code points
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    rising = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(rising), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(rising), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("w_left"))
        .withColumn("fits", F.col("level") * F.col("w") <= F.col("cap"))
    )
    level = F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(every)["level"]
    return per.select("source", "source_size", F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("w")).alias("target"))


def rate() -> Column:
    """Copies per document of a source, of its target and size; at most MOST_REPEATS."""
    return F.least(F.lit(float(MOST_REPEATS)), F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0)))


def drawn(key: str, seed: str) -> Column:
    """floor(s_rate), plus one if the key's number in [0, 1) is below the fraction."""
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    return F.floor("s_rate") + F.when(draw < F.col("s_rate") - F.floor("s_rate"), 1).otherwise(0)


def written_targets(sizes: DataFrame) -> DataFrame:
    """targets() as a table whose size is known before the join is planned: small, it is broadcast and texts stay where they are; else both sides are shuffled."""
    return materialize(targets(sizes), "targets").withColumnRenamed("source", "s_source")


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """key, source, size, source_size, target, copies of every row of docs.

    copies is floor(rate) plus one if a number in [0, 1) from md5(seed, key) is below rate's fraction; rate is target /
    source_size, at most MOST_REPEATS. The draw depends on the key alone, so reruns and repeated rows agree; a null key
    counts as an empty one, a null text has no token, and null is a source of its own. Other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), words(text).alias("size"))
    plan = written_targets(rows.select("source", "size"))
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s_source"))).withColumn("s_rate", rate())
    return joined.select("doc_id", "source", "size", "source_size", "target", drawn("doc_id", seed).cast("long").alias("copies"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: each row of docs as often as copies() says, with all its columns; those with no copy are absent."""
    own = [c for c in docs.columns]
    n = len(own)
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(own)))}
    plan = written_targets(plain.select(F.col(at[source]).alias("source"), words(at[text]).alias("size")))
    out = plain.join(plan, F.col(at[source]).eqNullSafe(F.col("s_source"))).withColumn("s_rate", rate()).withColumn("s_n", drawn(at[key], seed).cast("int"))
    return out.where("s_n > 0").withColumn("s_copy", F.explode(F.sequence(F.lit(1), F.col("s_n")))).select(*[f"c{i}" for i in range(n)]).toDF(*own)
