"""Aggregations: sold-history summaries, weighted nearest-rank percentiles, price summaries, shares.

Percentiles use a running weight inside the group. Groups are first reduced to one row for each value, so the
window sorts distinct values, not records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import col, round_half_up
from .ranking import top_per_key


def weighted_average(value, weight) -> Column:
    """Aggregate: sum(value * weight) / sum(weight), 0 without weight."""
    total = F.sum(col(weight))
    return F.when(total > 0, F.sum(col(value) * col(weight)) / total).otherwise(0.0)


def weighted_percentiles(rows: DataFrame, keys: list[str], value: str, weight: str, shares: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the least value whose running weight reaches max(1, ceil(total * share))."""
    by_value = rows.where(F.col(weight) > 0).groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    window = Window.partitionBy(*keys).orderBy(value)
    run = by_value.withColumns({"_run": F.sum("_w").over(window.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_w").over(Window.partitionBy(*keys))})
    at = lambda p: F.min(F.when(F.col("_run") >= F.greatest(F.lit(1), F.ceil(F.col("_all") * p)), F.col(value)))
    return run.groupBy(*keys).agg(*[at(p).alias(name) for name, p in shares.items()])


def retained(quantity, kept=None) -> Column:
    """Units that stayed sold: the known retained count, else the whole units of the row."""
    gross = F.greatest(F.lit(1), F.floor(col(quantity)))
    return gross if kept is None else F.when(col(kept) >= 0, col(kept)).otherwise(gross)


def sold_summary(records: DataFrame, keys: list[str], as_of: str) -> DataFrame:
    """Units in trailing windows, averages, percentiles, refund rate and last sale of every group.

    records: keys, units (retained), gross, cents (paid per unit), age (days before as_of), sale_date."""
    recent = lambda n: F.coalesce(F.sum(F.when(F.col("age").between(0, n), F.col("units"))), F.lit(0))
    base = records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"),
        F.sum("units").alias("units_sold"),
        F.sum("gross").alias("gross_units"),
        recent(30).alias("units_30"),
        recent(90).alias("units_90"),
        recent(365).alias("units_365"),
        (F.sum(F.col("cents") * F.col("units")) / F.nullif(F.sum("units"), F.lit(0)) / 100.0).alias("_average"),
        F.max(F.when(F.col("units") > 0, F.to_date("sale_date"))).alias("last_sale"),
    )
    base = base.withColumns({"average_price": F.coalesce(round_half_up("_average"), F.lit(0.0)), "refund_rate": round_half_up(F.lit(1) - F.col("units_sold") / F.col("gross_units"), 4)}).drop("_average")
    ranks = weighted_percentiles(records, keys, "cents", "units", {"p25": 0.25, "p50": 0.5})
    return base.join(ranks, keys, "left").withColumns({"p25": F.col("p25") / 100.0, "p50": F.col("p50") / 100.0})


def condition_units(records: DataFrame, keys: list[str], conditions: list[str]) -> DataFrame:
    """Units by condition, one column each."""
    return records.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("condition") == c, F.col("units"))), F.lit(0)).alias(f"units_{c}") for c in conditions])


def condition_metrics(records: DataFrame, keys: list[str], conditions: list[str]) -> DataFrame:
    """Average and last price by condition as a map, every condition present."""
    per = records.groupBy(*keys, "condition").agg(F.sum("units").alias("units"), (F.sum(F.col("cents") * F.col("units")) / F.nullif(F.sum("units"), F.lit(0)) / 100.0).alias("average"))
    found = per.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("condition", F.struct("units", "average")))).alias("_m"))
    none = F.struct(F.lit(0).cast("long").alias("units"), F.lit(None).cast("double").alias("average"))
    return found.select(*keys, F.map_from_arrays(F.array(*[F.lit(c) for c in conditions]), F.array(*[F.coalesce(F.col("_m")[c], none) for c in conditions])).alias("by_condition"))


def artist_rollup(records: DataFrame, artist: str, shown: str, release: str) -> DataFrame:
    """Per normalised artist: the shown name with most units, distinct releases, units."""
    names = records.groupBy(artist, shown).agg(F.sum("units").alias("u"))
    best = names.groupBy(artist).agg(F.min_by(shown, F.struct((-F.col("u")).alias("u"), F.col(shown))).alias("artist_name"))
    return records.groupBy(artist).agg(F.count_distinct(release).alias("releases"), F.sum("units").alias("units_sold"), F.count(F.lit(1)).alias("records")).join(best, artist)


def price_summary(listings: DataFrame, key: str, cents: str, threshold_cents: int = 500) -> DataFrame:
    """Least price, spread, cheapest-ten average, median, trimmed median, high outliers. Ranks instead of collected lists."""
    window = Window.partitionBy(key)
    ranked = listings.withColumns({"_r": F.row_number().over(window.orderBy(cents, *[c for c in listings.columns if c not in (key, cents)])), "_n": F.count(F.lit(1)).over(window)})
    middle = lambda low, high: F.avg(F.when(F.col("_r").between(low, high), F.col(cents)))
    n, trim = F.col("_n"), F.when(F.col("_n") > 2, F.lit(1)).otherwise(F.lit(0))
    m = n - 2 * trim
    return ranked.groupBy(key).agg(
        F.count(F.lit(1)).alias("listings"),
        (F.min(cents) / 100.0).alias("least_price"),
        ((F.max(cents) - F.min(cents)) / 100.0).alias("spread"),
        (F.avg(F.when(F.col("_r") <= 10, F.col(cents))) / 100.0).alias("cheapest_ten"),
        (middle(F.floor((n + 1) / 2), F.floor((n + 2) / 2)) / 100.0).alias("median_price"),
        (middle(trim + F.floor((m + 1) / 2), trim + F.floor((m + 2) / 2)) / 100.0).alias("trimmed_median"),
        F.sum(F.when(F.col(cents) >= 3 * threshold_cents, 1).otherwise(0)).alias("high_outliers"),
    )


def consensus(rows: DataFrame, group: str, cluster: str, order: str) -> DataFrame:
    """Most frequent cluster of each group with its share; ties go to the one seen first."""
    per = rows.groupBy(group, cluster).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("seen"))
    return per.groupBy(group).agg(F.min_by(cluster, F.struct((-F.col("n")).alias("n"), "seen")).alias("consensus"), F.max("n").alias("votes"), F.sum("n").alias("total")).withColumn("share", round_half_up(F.col("votes") / F.col("total"), 4)).drop("total")


def concentration(rows: DataFrame, group: str, source: str) -> DataFrame:
    """Largest share and Herfindahl index of sources within each group."""
    per = rows.groupBy(group, source).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(group).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sources"), F.max("n").alias("most"), F.sum(F.col("n") * F.col("n")).alias("squares"))
    return total.select(group, "total", "sources", round_half_up(F.col("most") / F.col("total"), 4).alias("largest_share"), round_half_up(F.col("squares") / (F.col("total") * F.col("total")), 4).alias("hhi"))


def economics(records: DataFrame, by: str) -> DataFrame:
    """Fees, refunds and net of records by currency or another group, in cents throughout."""
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("records"), F.sum("paid").alias("paid_cents"), F.sum("fees").alias("fee_cents"), F.sum("refund").alias("refund_cents"), F.sum(F.col("paid") - F.col("fees") - F.col("refund")).alias("net_cents"), F.count_if(F.col("refund") > 0).alias("refunded"), F.count_if(F.col("refund") >= F.col("paid") * 0.95).alias("fully_refunded"))


def nearest_rank(values: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Unweighted nearest-rank percentiles."""
    return weighted_percentiles(values.withColumn("_one", F.lit(1)), keys, value, "_one", shares)


def expansion_tokens(listings: DataFrame, search: str, words: str, order: list[Column], excluded: str | None = None, first: int = 25, k: int = 5, least: int = 2) -> DataFrame:
    """Words that widen a search: of its first listings the k words in most titles, then nearest the start.

    words: a listing's words in order; excluded: words of the search itself. Columns: search, token, listings, first_pos. Searches with
    fewer than two such words have none."""
    some = top_per_key(listings, [search], order, first, "_n")
    out = some.select(search, *([excluded] if excluded else []), "_n", F.posexplode(words).alias("pos", "token"))
    if excluded:
        out = out.where(~F.array_contains(excluded, F.col("token")))
    per = out.groupBy(search, "token").agg(F.count(F.lit(1)).alias("listings"), F.min("pos").alias("first_pos")).where(F.col("listings") >= least)
    best = top_per_key(per, [search], [F.desc("listings"), F.col("first_pos"), F.col("token")], k, "_rank")
    enough = best.groupBy(search).agg(F.count(F.lit(1)).alias("_c")).where("_c >= 2").select(search)
    return best.join(enough, search, "left_semi").drop("_rank")
