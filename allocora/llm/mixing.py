"""Mix sources to target weights: repetition rates from token sums, copies by a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allocora.llm.common import WORD_SQL
from allocora.runtime import small_table

#: A source is repeated this often at most.
MAX_REPEATS = 3
#: Weights given to the sources in turn.
WEIGHTS = (1, 2, 3)


def word_count(text: str | Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Target of each source, from one row (source, source_size) per source.

    Sources in code-point order, null last, get ``weights`` in turn and share the
    sum of all sizes by them. No target is above ``max_repeats`` sizes: walking
    up the sources by cap per weight, a source is held at its cap as long as the
    share of what is left would be above it, which is where resharing the excess
    again and again ends. An empty table gives an empty table, sizes of 0 a
    target of 0.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    ordered = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
        .withColumn("cap", F.col("source_size").cast("double") * max_repeats)
        .withColumn("left", F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()))
        .withColumn("left", F.col("left") - F.sum("cap").over(by_cap) + F.col("cap"))
        .withColumn("weights_left", F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("capped", F.col("cap") * F.col("weights_left") <= F.col("left") * F.col("weight"))
        .withColumn("first", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), -F.col("weights_left"), "weights_left", "left"))).over(Window.partitionBy()))
    )
    shared = F.col("weight") * F.col("first.left") / F.col("first.weights_left")
    return ordered.select(
        "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(shared).alias("target")
    )


def draw(doc_id: str, text: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the row alone."""
    key = F.concat_ws(
        ":",
        F.lit(str(seed)),
        F.coalesce(F.col(doc_id).cast("string"), F.lit("null")),
        F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")),
    )
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("double") / float(2**52)


def with_copies(
    docs: DataFrame, max_repeats: int = MAX_REPEATS, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, prefix: str = "mix_"
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies``, named with ``prefix``.

    Words per source are summed first (combined in every task, so a hot source
    costs no more than another). The table of sources is broadcast if it is proven
    small; beyond that the join is a shuffle join. A row is taken floor(rate)
    times, and once more if its own draw is below the fraction, so reruns and lost
    executors change nothing. Null texts have size 0; a null source is a source;
    repeated rows get the same draw. Columns of ``docs`` that are called like the
    new ones are replaced.
    """
    size, source_size, target, copies, key = (prefix + n for n in ("size", "source_size", "target", "copies", "source"))
    sized = docs.drop(size, source_size, target, copies).withColumn(size, word_count("text"))
    sizes = sized.groupBy("source").agg(F.sum(size).alias("source_size"))
    targets = small_table(
        source_targets(sizes, max_repeats, weights).select(
            F.col("source").alias(key), F.col("source_size").alias(source_size), F.col("target").alias(target)
        )
    )
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(key))).drop(key)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    extra = draw("doc_id", "text", seed) < rate - F.floor(rate)
    return joined.withColumn(copies, F.floor(rate) + extra.cast("long"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns it had."""
    taken = with_copies(docs, prefix="__mix_", **options).filter("__mix_copies > 0")
    copies = taken.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int"))))
    return copies.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text,
    CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight,
    CAST(source_size AS DOUBLE) * 3 AS cap
  FROM s
), o AS (
  SELECT *, (SELECT CAST(sum(source_size) AS DOUBLE) FROM s)
      - sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST) + cap AS rest,
    sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left
  FROM w
), c AS (SELECT *, cap * weights_left <= rest * weight AS capped FROM o),
f AS (SELECT rest AS free, weights_left AS free_weights FROM c WHERE NOT capped ORDER BY cap / weight, weights_left DESC LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight * free / free_weights END AS target
  FROM c LEFT JOIN f ON TRUE
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('17:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(d.text, ''))), 1, 13) AS BIGINT) AS DOUBLE)
      / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
