"""Sale campaigns: observations to campaigns, conflicting leads, coverage of sources, offer claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.candidates import ascii_words, folded, says
from ..functions.decisions import chosen
from ..functions.money import col

# How an observation's scope counts, and the order of states.
SCOPE_POINTS = {"sitewide": 500, "vinyl-wide": 400, "clearance": 300}
STATUS_ORDER = ["new", "changed", "ongoing", "evergreen", "unknown", "ended"]
FAILED = ["blocked", "failed", "error", "timeout", "unavailable", "not_found"]
REACHED = ["healthy", "partial", "success"]


def observation_priority(verified, url, scope, discount, evidence) -> Column:
    """Confirmed by the retailer's page, on a sale page, wide, deep, well evidenced: in that order."""
    points = chosen([(F.lower(F.trim(col(scope))) == k, v) for k, v in SCOPE_POINTS.items()], 200)
    sale_page = F.coalesce(col(url).rlike(r"(?i)\b(sale|clearance|deal|garage|overstock|promo)\b"), F.lit(False))
    return F.when(col(verified), 1_000_000).otherwise(0) + F.when(sale_page, 10_000).otherwise(0) + points + F.coalesce(col(discount), F.lit(0.0)) * 100 + F.coalesce(F.length(col(evidence)), F.lit(0))


def eligible_observations(rows: DataFrame, base: list[str], terms: list[str], verified: str = "verified") -> DataFrame:
    """Where a campaign has a confirmed observation, unconfirmed ones stay only if their terms equal a confirmed one's.

    The test is a join on base and terms and one on base, not a list per campaign: a campaign may have any number of observations."""
    def joined(left: DataFrame, names: list[str], flag: str) -> DataFrame:
        right = rows.where(F.col(verified)).select(*[F.col(n).alias(f"_k_{n}") for n in names]).distinct().withColumn(flag, F.lit(True))
        on = [F.col(n).eqNullSafe(F.col(f"_k_{n}")) for n in names]
        return left.join(right, on, "left").drop(*[f"_k_{n}" for n in names])

    tagged = joined(joined(rows, base, "_any"), [*base, *terms], "_same")
    return tagged.where(F.col(verified) | F.col("_any").isNull() | F.col("_same").isNotNull()).drop("_any", "_same")


def merged_observations(rows: DataFrame, keys: list[str], priority: Column, order: list[Column], count: str = "seen", url: str = "url") -> DataFrame:
    """One row for each key: its best observation, the observations counted, the distinct pages, first and last sighting."""
    ranked = rows.withColumn("_p", priority)
    best = ranked.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_p"), *order))).where("_r = 1").drop("_r", "_p", count)
    sums = rows.groupBy(*keys).agg(F.sum(F.greatest(F.coalesce(F.col(count), F.lit(1)), F.lit(1))).alias("observations"), F.count_distinct(url).alias("pages"), F.min("seen_at").alias("first_seen"), F.max("seen_at").alias("last_seen"))
    return best.join(sums, keys)


def highest_status(status) -> Column:
    """Aggregate: the status that comes first in the order of states."""
    rank = chosen([(col(status) == s, i) for i, s in enumerate(STATUS_ORDER)], len(STATUS_ORDER))
    return F.min_by(col(status), rank)


def source_coverage(meaningful, failed, sale_failed, partial, catalog_reached, catalog_failed, attempted) -> Column:
    """healthy, degraded, blocked, empty or not_checked."""
    return chosen(
        [
            (col(meaningful) & (col(failed) | col(sale_failed) | col(partial)), "degraded"),
            (col(meaningful), "healthy"),
            (col(sale_failed) & col(catalog_reached) & ~col(catalog_failed), "degraded"),
            (col(sale_failed) | col(failed), "blocked"),
            (col(attempted), "empty"),
        ],
        "not_checked",
    )


def page_health(checked_urls, known_urls, url, report) -> Column:
    """Health of one page in a source's report: checked itself, unknown where only other pages were, else the report's."""
    return F.when(F.array_contains(col(checked_urls), col(url)), "success").when(F.size(col(known_urls)) > 0, "unknown").otherwise(col(report))


# What is an offer, how far it reaches, and goods that are no records.
OFFER = r"\b(?:[1-9]\d?\s*(?:%|percent)\s*off|bogo|buy\s+(?:one|1)\s+get\s+(?:one|1)|promo\s+code|coupon\s+code|use\s+code)\b"
CLAIMS = {
    "sitewide": r"\b(?:sitewide|site-wide|storewide|store-wide|entire\s+(?:site|store)|everything)\b",
    "vinyl-wide": r"\b(?:all\s+(?:vinyl|records|lps|music)|vinyl\s+(?:sale|discount|deals?))\b",
    "any": r"\b(?:sitewide|site-wide|storewide|store-wide|entire\s+(?:site|store)|everything|all\s+(?:vinyl|records|lps|music)|vinyl\s+(?:sale|discount|deals?))\b",
}
OTHER_GOODS = r"\b(?:apparel|clothing|t-?shirts?|hoodies?|merch(?:andise)?|accessories|cds?|cassettes?|tapes?|books?|posters?|homeware)\b"


def places(text: Column, pattern: str) -> Column:
    """array<struct<start, end>> of the matches of a pattern, from 1, ends past the last character: the lengths of what stands between them add up."""
    found, between = F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(0)), F.split(text, ascii_words(pattern), -1)
    upto = lambda parts, n: F.length(F.array_join(F.slice(parts, 1, n), ""))
    one = lambda i: F.struct((upto(between, i) + upto(found, i - 1) + 1).alias("start"), (upto(between, i) + upto(found, i) + 1).alias("end"))
    none = F.array().cast("array<struct<start: int, end: int>>")
    return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(1), F.size(found)), one)).otherwise(none)


def coherent_claim(text, scope: str = "any") -> Column:
    """Whether any offer and any claim about its reach (of this scope) stand within 64 characters of each other, with no other goods named in the stretch of both."""
    value = folded(F.coalesce(col(text), F.lit("")))

    def together(offer: Column, claim: Column) -> Column:
        first, last = F.least(offer["start"], claim["start"]), F.greatest(offer["end"], claim["end"])
        gap = F.greatest(offer["start"], claim["start"]) - F.least(offer["end"], claim["end"])
        return (gap <= 64) & ~says(F.substring(value, first, last - first), OTHER_GOODS)

    return F.exists(places(value, OFFER), lambda offer: F.exists(places(value, CLAIMS[scope]), lambda claim: together(offer, claim)))
