"""Research evidence: listings and research rows matched to finds, weighted evidence, best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.decisions import chosen
from ..functions.money import col, round_half_up
from .ranking import best_per_key


def coverage(wanted: Column, have: Column, empty: float = 0.0) -> Column:
    """Share of the wanted words that are there."""
    return F.when(F.size(wanted) > 0, F.size(F.filter(wanted, lambda w: F.array_contains(have, w))) / F.size(wanted).cast("double")).otherwise(F.lit(empty))


def listing_match(title: Column, artist: Column, listing: Column, edition: Column, listing_edition: Column) -> dict[str, Column]:
    """score, matched and reasons of an active listing against a find; arguments are word and signal arrays.

    Title words count 0.65, artist words 0.2, an equal edition 0.15."""
    hits, n = F.size(F.filter(title, lambda w: F.array_contains(listing, w))), F.size(title)
    t, a = coverage(title, listing), coverage(artist, listing, 1.0)
    needed = F.when(n <= 2, n).otherwise(F.greatest(F.lit(2), F.ceil(n * 0.6)))
    numbers = F.forall(F.filter(title, lambda w: w.rlike(r"^\d+$")), lambda w: F.array_contains(listing, w))
    missing, extra = F.array_except(edition, listing_edition), F.array_except(listing_edition, edition)
    exact = (F.size(missing) == 0) & (F.size(extra) == 0)
    score = round_half_up(t * 0.65 + a * 0.2 + F.when(exact, 0.15).when(F.size(extra) == 0, 0.075).otherwise(0.0), 3)
    reasons = F.array_compact(F.array(F.when((hits < needed) | ~numbers, "title"), F.when((F.size(artist) > 0) & (a < 0.5), "artist"), F.when(F.size(missing) > 0, "edition-missing"), F.when(F.size(extra) > 0, "edition-extra")))
    return {"score": score, "reasons": reasons, "matched": (F.size(reasons) == 0) & (t >= 0.6) & exact & (score >= 0.8)}


def research_score(title: Column, artist: Column, row: Column, row_text: Column) -> Column:
    """Match of a research row: title words 0.68, artist words 0.2, a format word 0.06; zero where too few title words are there."""
    t, a, n = coverage(title, row), coverage(artist, row, 1.0), F.size(title)
    floor = F.when(n <= 2, 1.0).when(n <= 4, 0.67).otherwise(0.55)
    apart = (n == 2) & ~F.contains(F.concat(F.lit(" "), F.array_join(row, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(title, " "), F.lit(" ")))
    stranger = (F.size(artist) > 0) & (a == 0) & (n < 5)
    bonus = F.when(row_text.rlike(r"(?i)\b(?:vinyl|lp|record)\b"), 0.06).otherwise(0.0)
    return F.when((n == 0) | (t < floor) | apart | stranger, 0.0).otherwise(F.least(F.lit(1.0), t * 0.68 + a * 0.2 + bonus))


def entry_score(title: Column, target: Column, entry: Column) -> Column:
    """How well a research entry fits: the better of title coverage, discounted entry coverage and their harmonic mean."""
    t, e = coverage(title, entry), coverage(entry, target)
    harmonic = F.when(t + e > 0, 2 * t * e / (t + e)).otherwise(0.0)
    return F.when((F.size(entry) >= 2) & (e == 1), F.greatest(F.lit(0.92), t)).otherwise(F.greatest(t, e * 0.9, harmonic))


def confidence_of(score) -> Column:
    return chosen([(col(score) >= 0.88, "high"), (col(score) >= 0.76, "medium")], "low")


def run_evidence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence of each run: units, weighted averages over rows with the value, the strongest row, the last sale.

    rows: keys, sold, price, shipping, score, last_sold."""
    over = lambda c: F.sum(F.when(F.col(c).isNotNull(), F.col(c) * F.col("sold"))) / F.nullif(F.sum(F.when(F.col(c).isNotNull(), F.col("sold"))), F.lit(0))
    return rows.groupBy(*keys).agg(F.sum("sold").alias("units"), round_half_up(over("price")).alias("average_price"), round_half_up(over("shipping")).alias("average_shipping"), round_half_up(over("score"), 4).alias("match_score"), F.max("sold").alias("largest_row"), F.max("last_sold").alias("last_sold"))


def best_run(evidence: DataFrame, find: str, run: str) -> DataFrame:
    """The run of each find with most units, then the better match."""
    return best_per_key(evidence, [find], [F.desc("units"), F.desc_nulls_last("match_score"), F.col(run)])


def exact_else_fuzzy(finds: DataFrame, exact: DataFrame, fuzzy: DataFrame, find: str) -> DataFrame:
    """Entries recorded under a find's own id shadow those matched by words, even when they are empty."""
    named = exact.withColumn("match", F.lit("exact"))
    rest = fuzzy.join(exact.select(find).distinct(), find, "left_anti").withColumn("match", F.lit("fuzzy"))
    return finds.select(find).join(named.unionByName(rest), find)


def dated_windows(rows: DataFrame, keys: list[str], full_page: int = 50) -> DataFrame:
    """Units in 30, 90 and 365 days, only where every row is one dated sale of its own listing and the page isn't full; else null.

    rows: keys, sold, age (days), listing."""
    sound = F.bool_and((F.col("sold") == 1) & F.col("age").isNotNull() & F.col("listing").isNotNull()) & (F.count(F.lit(1)) < full_page) & (F.count_distinct("listing") == F.count(F.lit(1)))
    return rows.groupBy(*keys).agg(sound.alias("sound"), *[F.count_if(F.col("age").between(0, n)).alias(f"_u{n}") for n in (30, 90, 365)]).select(*keys, "sound", *[F.when(F.col("sound"), F.col(f"_u{n}")).alias(f"units_{n}") for n in (30, 90, 365)])
