"""Joins of panels, lookups and names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allocora.functions.text import name_key, trim_unicode
from allocora.runtime import small_table


#: Letters in a gram of a name.
GRAM = 4
#: Grams known as frequent; the others count as equally rare.
FREQUENT_GRAMS = 4096
#: Aliases of one length that may share a gram before they are compared by shortened forms.
MOST_ALIASES = 1000


class DuplicateKeyError(ValueError):
    """A lookup would multiply the rows it is joined to."""


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> None:
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise DuplicateKeyError(f"duplicate keys in {list(keys)}")


def merge_sources(anchor: DataFrame, sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Left-join every source onto the anchor by the panel key.

    All joins share one key, so the anchor is shuffled once.
    """
    out = anchor
    for source in sources:
        out = out.join(source, list(keys), "left")
    return out


def guarded_left_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join that refuses a right side with duplicate keys."""
    assert_unique_key(right, keys)
    return left.join(right, list(keys), "left")


def attach(df: DataFrame, lookup: DataFrame, keys: Sequence[str] | str) -> DataFrame:
    """Left join of a lookup that is broadcast only when proven small."""
    return df.join(small_table(lookup), [keys] if isinstance(keys, str) else list(keys), "left")


def membership_flag(df: DataFrame, members: DataFrame, key: str, flag: str) -> DataFrame:
    """1 where the key is among ``members``, else 0; members proven few are broadcast, so hot keys stay where they are."""
    ids = members.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(flag, F.lit(1))
    return df.join(small_table(ids), key, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(0)))


def aligned_difference(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """a − b for the keys both sides have."""
    right = b.select(key, F.col(value).alias("_b"))
    return a.select(key, value).join(right, key, "inner").withColumn(value, F.col(value) - F.col("_b")).drop("_b")


def shortened(key: str, max_edits: int) -> Column:
    """The key and every text left after up to ``max_edits`` deletions."""
    forms = F.array(F.col(key))
    last = forms
    for _ in range(max_edits):
        last = F.array_distinct(
            F.flatten(
                F.transform(
                    last,
                    lambda t: F.transform(
                        F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))),
                        lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))),
                    ),
                )
            )
        )
        forms = F.array_union(forms, last)
    return forms


def grams(key: str) -> Column:
    """The different runs of ``GRAM`` letters in a text with padded ends."""
    pad = F.lit("\u0001" * (GRAM - 1))
    return F.array_distinct(
        F.transform(
            F.sequence(F.lit(1), F.length(key) + (GRAM - 1)),
            lambda i: F.substring(F.concat(pad, F.col(key), pad), i, F.lit(GRAM)),
        )
    )


def _rarest(keys: DataFrame, key: str, frequent: DataFrame, most: int) -> DataFrame:
    """A row for each of a key's ``most`` rarest grams, with its length and whether it has no more grams than edits can change."""
    order = Window.partitionBy(key).orderBy(F.coalesce("_n", F.lit(0)), "_gram")
    return (
        keys.withColumn("_grams", grams(key))
        .select("*", (F.size("_grams") < most).alias("_short"), F.explode("_grams").alias("_gram"), F.length(key).alias("_len"))
        .drop("_grams")
        .join(frequent, "_gram", "left")
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= most)
        .drop("_rank", "_n")
    )


def _form_pairs(wanted: DataFrame, offered: DataFrame, max_edits: int) -> DataFrame:
    """Pairs that share a text reachable by deletions.

    Texts that share only the empty one are as far apart as the longer one is long, so
    the first alias of each length stands for all of that length.
    """
    forms = offered.select("_cand", "_code", F.explode(shortened("_cand", max_edits)).alias("_form"))
    emptied = forms.filter("_form = ''").groupBy(F.length("_cand")).agg(F.min(F.struct("_cand", "_code")).alias("_first"))
    offers = forms.filter("_form <> ''").unionByName(emptied.select("_first._cand", "_first._code", F.lit("").alias("_form")))
    return wanted.select("_key", F.explode(shortened("_key", max_edits)).alias("_form")).join(offers, "_form").drop("_form")


def near_pairs(wanted: DataFrame, offered: DataFrame, max_edits: int, most_aliases: int = MOST_ALIASES) -> DataFrame:
    """Candidates (_key, _cand, _code) that include every pair of texts at most ``max_edits`` apart.

    An edit changes at most ``GRAM`` grams. So of two texts n edits apart, one of them
    with more than n * ``GRAM`` grams, the n * ``GRAM`` + 1 rarest grams of each have one
    in common, and the lengths differ by n at most: the join is on gram and length.
    Texts with fewer grams, and those with a gram that more than ``most_aliases``
    aliases of one length offer, meet by shortened forms instead. At most as many
    aliases share a form as ``max_edits`` insertions can make of it. For a single edit
    the forms alone are fewer and more telling than the grams.
    """
    if max_edits < 2:
        return _form_pairs(wanted, offered, max_edits)
    most = GRAM * max_edits + 1
    counts = offered.select(F.explode(grams("_cand")).alias("_gram")).groupBy("_gram").agg(F.count("*").alias("_n"))
    frequent = F.broadcast(counts.orderBy(F.desc("_n"), "_gram").limit(FREQUENT_GRAMS))
    offers = _rarest(offered, "_cand", frequent, most)
    probes = _rarest(wanted, "_key", frequent, most).withColumn(
        "_len", F.explode(F.sequence(F.col("_len") - max_edits, F.col("_len") + max_edits))
    )
    on = ["_gram", "_len"]
    crowded = small_table(offers.groupBy(*on).count().filter(F.col("count") > most_aliases).select(*on))
    by_gram = probes.join(offers.join(crowded, on, "left_anti").drop("_short"), on).select("_key", "_cand", "_code")

    def apart(rows: DataFrame, *names: str) -> DataFrame:
        return rows.filter("_short").select(*names).union(rows.join(crowded, on, "left_semi").select(*names)).distinct()

    return by_gram.union(_form_pairs(apart(probes, "_key"), apart(offers, "_cand", "_code"), max_edits))


def resolve_names(
    names: DataFrame,
    aliases: DataFrame,
    overrides: DataFrame,
    name: str = "name",
    code: str = "code",
    max_edits: int = 1,
) -> DataFrame:
    """Code of each name: override, then exact alias, then nearest alias.

    The nearest-alias step sees only names the first two leave over, and compares
    them with the aliases of :func:`near_pairs` only; of equally near aliases the
    first counts. Names without a code stay, with a NULL code and method.
    """
    keyed = names.select(trim_unicode(name).alias(name)).distinct().withColumn("_key", name_key(name))
    alias = aliases.groupBy(name_key(name).alias("_key")).agg(F.min(code).alias("_alias"))
    over = overrides.groupBy(name_key(name).alias("_key")).agg(F.min(code).alias("_over"))
    exact = keyed.join(over, "_key", "left").join(alias, "_key", "left")
    left_over = exact.filter("_over IS NULL AND _alias IS NULL AND _key IS NOT NULL").select("_key").distinct()
    offered = alias.filter("_key IS NOT NULL").select(F.col("_key").alias("_cand"), F.col("_alias").alias("_code"))
    nearest = (
        near_pairs(left_over, offered, max_edits)
        .withColumn("_d", F.levenshtein("_key", "_cand", max_edits))
        .filter(F.col("_d") >= 0)
        .groupBy("_key")
        .agg(F.min_by("_code", F.struct("_d", "_cand")).alias("_near"))
    )
    return exact.join(nearest, "_key", "left").select(
        name,
        F.coalesce("_over", "_alias", "_near").alias(code),
        F.when(F.col("_over").isNotNull(), "override")
        .when(F.col("_alias").isNotNull(), "alias")
        .when(F.col("_near").isNotNull(), "nearest")
        .alias("method"),
    )


def unresolved(resolved: DataFrame, name: str = "name", code: str = "code") -> DataFrame:
    return resolved.filter(F.col(code).isNull()).select(name)


def lookup_with_override(
    df: DataFrame, key: str, group: str, overrides: DataFrame, lookup: DataFrame, value: str
) -> DataFrame:
    """``value`` from the override of the key, else from the lookup of its group."""
    over = overrides.select(key, F.col(value).alias("_over"))
    base = lookup.select(group, F.col(value).alias("_base"))
    return (
        attach(attach(df, over, key), base, group)
        .withColumn(value, F.coalesce("_over", "_base"))
        .drop("_over", "_base")
    )
