"""Orders of rows as lists of Columns, for orderBy, windows and top-k; and what is shown of a run: filters and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.candidates import says
from ..functions.decisions import chosen
from ..functions.money import col, positive_amount
from .ranking import best_per_key

# How states and decisions rank.
STATUS_RANK = {"new": 6, "changed": 5, "ongoing": 4, "unknown": 3, "evergreen": 2, "ended": 1}
DECISION_RANK = {"BUY": 4, "WATCH": 3, "REVIEW": 2}
BAND_RANK = {"A": 4, "B": 3, "C": 2}
ACTIVE_STATUSES = ["new", "changed", "ongoing", "evergreen"]
GONE = r"\b(?:out\s+of\s+stock|sold\s+out|unavailable)\b"


def rank_of(value, ranks: dict[str, int], otherwise: int = 0) -> Column:
    return chosen([(col(value) == k, v) for k, v in ranks.items()], otherwise)


def ranked_candidates(quality="quality", source="source_name", title="title") -> list[Column]:
    """Best quality first, then by source and title."""
    return [col(quality).desc(), F.coalesce(col(source), F.lit("")).asc(), F.coalesce(col(title), F.lit("")).asc()]


def duplicate_offers(available="available", stock="stock", sold_by_source="sold_by_source", price="price", **ranked) -> list[Column]:
    """Of one pressing the offer to take: available, sold by the source, with a known price, cheapest; then as candidates rank."""
    gone = col(available).eqNullSafe(F.lit(False)) | says(F.coalesce(col(stock), F.lit("")), GONE)
    return [gone.asc(), col(sold_by_source).eqNullSafe(F.lit(False)).asc(), positive_amount(price).asc_nulls_last(), *ranked_candidates(**ranked)]


def campaigns(status="status", seen="last_seen", key="id") -> list[Column]:
    """Newest states first, then the latest sighting, then the id."""
    return [rank_of(status, STATUS_RANK).desc(), F.coalesce(col(seen), F.lit("1970-01-01").cast("timestamp")).desc(), col(key).asc()]


def shelf(status="status", seen="last_seen", captured="captured_at") -> list[Column]:
    """Campaigns as they are shown: state, then the latest sighting, else when they were captured."""
    return [rank_of(status, STATUS_RANK).desc(), F.coalesce(col(seen), col(captured)).desc()]


def evaluated(decision="decision", score="score", net="net_profit", quality="quality") -> list[Column]:
    """Decision, priority score, profit (an unknown or zero one last), quality."""
    return [rank_of(decision, DECISION_RANK, 1).desc(), F.coalesce(col(score), F.lit(0)).desc(), F.when(col(net) != 0, col(net)).desc_nulls_last(), col(quality).desc()]


def records(sale_date="sale_date", key="record_key") -> list[Column]:
    return [F.coalesce(col(sale_date).cast("string"), F.lit("")).asc(), F.coalesce(col(key), F.lit("")).asc()]


def sources(priority="priority", name="name") -> list[Column]:
    return [col(priority).asc(), col(name).asc()]


def _directed(value: Column, descending: bool) -> Column:
    return value.desc() if descending else value.asc()


def finds(key: str, descending: bool | None = None, title="title") -> list[Column]:
    """Finds by one of priority, price, profit_rate, turn, velocity, long_term_supply, source, title; ties by title. Unknown numbers are worst."""
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    known = lambda c, otherwise: F.coalesce(col(c).cast("double"), otherwise)
    values = {
        "priority": rank_of("decision", DECISION_RANK, 1) * 1_000_000 + rank_of("band", BAND_RANK, 1) * 1_000 + col("score"),
        "price": col("price"),
        "profit_rate": known("profit_per_30", low),
        "turn": known("days_to_sell", high),
        "velocity": known("sales_per_month", low),
        "long_term_supply": F.coalesce(col("long_supply_months").cast("double"), known("supply_months", high)),
        "source": F.lower(col("source_name")),
        "title": F.lower(col(title)),
    }
    down = descending if descending is not None else key not in ("price", "source", "long_term_supply", "title", "turn")
    return [_directed(values[key], down), col(title).asc()]


def ledger(key: str, descending: bool = False, title="title") -> list[Column]:
    """Rows of the bulk ledger by album, buy, sale, reference, profit, category, condition or order; rows without figures last, by profit first when ascending."""
    high, low = F.lit(float("inf")), F.lit(float("-inf"))
    values = {
        "album": F.lower(col(title)),
        "buy": F.coalesce(col("buy_price"), high),
        "sale": F.coalesce(col("sale_price"), high),
        "reference": F.coalesce(col("median"), high),
        "profit": F.coalesce(col("profit"), low),
        "category": chosen([(col("category") == "under_5", 0), (col("category") == "5_to_25", 1), (col("category") == "over_25", 2)], 3),
        "condition": col("condition"),
        "order": col("order"),
    }
    return [_directed(values[key], descending), col(title).asc()]


def active_domains(catalogue: DataFrame) -> DataFrame:
    """One source for each domain, the first by priority and name; sources that only discover are left out."""
    return best_per_key(catalogue.where(~F.col("discovery_only")), ["domain"], sources())


def visible_finds(rows: DataFrame, decision: str = "ALL", source: str = "ALL") -> DataFrame:
    """What a review shows: one retailer's, or all; hidden ones (dismissed or with a bad outcome) and tracked ones only where they are asked for."""
    bad = F.col("outcome").isin("sold_low", "not_found", "bad_match", "passed")
    hidden = F.col("dismissed_at").isNotNull() | F.coalesce(bad, F.lit(False))
    tracked = F.col("outcome").isNotNull() & ~F.coalesce(bad, F.lit(False))
    out = rows if source == "ALL" else rows.where(F.col("source") == source)
    if decision == "DISMISSED":
        return out.where(hidden)
    if decision == "TRACKED":
        return out.where(tracked)
    open_ = out.where(~hidden & ~tracked)
    return open_ if decision == "ALL" else open_.where(F.col("decision") == ("REVIEW" if decision == "NEEDS_VALIDATION" else decision))


def campaign_history(campaigns_: DataFrame, events: DataFrame, limit: int, source: str | None = None, status: str | None = None) -> DataFrame:
    """The latest events, newest first, of campaigns of one source or into one state."""
    if source is not None:
        events = events.where(F.col("source") == source).join(campaigns_.where(F.col("source") == source).select("campaign"), "campaign", "left_semi")
    if status is not None:
        events = events.where(F.col("to_status") == status)
    return events.orderBy(F.desc("seq")).limit(limit)


def direct_report(crawl, group, retail) -> Column:
    """Whether a source report is of a shop itself, not of a place that points at shops."""
    low = lambda c: F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    return ~low(crawl).isin("deal-aggregator", "social-feed") & (low(group) != "discovery sources") & (low(retail) != "distributor_discovery")


def parse_health(candidates, attempted, available) -> Column:
    """productive, not_attempted, empty or failed."""
    n = lambda c: F.coalesce(col(c), F.lit(0))
    return chosen([(n(candidates) > 0, "productive"), (n(attempted) == 0, "not_attempted"), (n(available) > 0, "empty")], "failed")


def coverage_bucket(status, product, usable, catalog, sale) -> Column:
    """blocked, degraded or healthy, as a source report is shown."""
    is_ = lambda c, *values: F.coalesce(col(c).isin(*values), F.lit(False))
    tried = F.filter(F.array(col(catalog), col(sale)), lambda h: h.isNotNull() & ~h.isin("", "not_attempted", "not_checked"))
    failed = F.filter(tried, lambda h: h == "failed")
    partial = is_(status, "partial") | is_(catalog, "partial") | is_(sale, "partial") | is_(product, "empty") | is_(usable, "parser_empty", "raw_candidates")
    return chosen(
        [
            (is_(status, "error") | is_(product, "failed") | is_(usable, "unavailable"), "blocked"),
            (partial, "degraded"),
            ((F.size(tried) > 0) & (F.size(failed) == F.size(tried)), "blocked"),
            (F.size(failed) > 0, "degraded"),
        ],
        "healthy",
    )


def coverage_summary(reports: DataFrame) -> DataFrame:
    """One row: sources attempted, by bucket, and how their product pages and sale pages did. reports: bucket, product, usable, sale, sale_pages, priority."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    b, tried = F.col("bucket"), F.col("product").isNotNull() & (F.col("product") != "not_attempted")
    return reports.agg(
        F.count(F.lit(1)).alias("attempted"),
        *[n(b == x).alias(x) for x in ("healthy", "degraded", "blocked")],
        n(tried).alias("product_attempted"),
        n(tried & F.col("usable").isin("selected", "high_signal")).alias("product_usable"),
        n(tried & (F.col("product") == "empty")).alias("parser_empty"),
        n(tried & (F.col("product") == "failed")).alias("product_failed"),
        n((F.col("sale_pages") > 0) | F.col("sale").isin("healthy", "partial")).alias("sale_capable"),
        n(F.col("priority") == 1).alias("priority_total"),
        n((F.col("priority") == 1) & (b == "healthy")).alias("priority_healthy"),
    )


def finds_summary(rows: DataFrame) -> DataFrame:
    """One row: finds in all, by decision where neither dismissed nor with an outcome, and those with validated evidence."""
    open_ = F.col("dismissed_at").isNull() & F.col("outcome").isNull()
    return rows.agg(
        *[F.count_if(open_ & (F.col("decision") == d)).alias(d.lower()) for d in ("BUY", "WATCH", "REVIEW", "REJECT")],
        F.count_if(F.col("sold_evidence")).alias("sold_validated"),
        F.count_if(F.col("active_evidence")).alias("active_validated"),
        F.count(F.lit(1)).alias("total"),
    )


def scan_summary(rows: DataFrame) -> DataFrame:
    """One row of a scan: finds by decision, sources, the largest source's share and the concentration (sum of squared shares)."""
    per = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("decision") == d).alias(d.lower()) for d in ("BUY", "WATCH", "REVIEW", "REJECT")])
    total = F.sum("n")
    squares = F.sum(F.col("n") * F.col("n"))
    return per.agg(total.alias("finds"), F.count(F.lit(1)).alias("sources"), *[F.sum(d).alias(d) for d in ("buy", "watch", "review", "reject")], F.round(F.max("n") / total, 4).alias("largest_share"), F.round(squares / (total * total), 4).alias("concentration"))


def campaign_summary(rows: DataFrame) -> DataFrame:
    """One row: campaigns in all, active ones, and those in each state."""
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status").isin(ACTIVE_STATUSES)).alias("active"), *[F.count_if(F.col("status") == s).alias(s) for s in sorted(STATUS_RANK)])


def finalised(prior_from, prior_to, range_from, range_to) -> Column:
    """struct<from, to> of a finished sync: the cursor moves forwards only."""
    ahead = col(prior_to).isNull() | (col(range_to) >= col(prior_to))
    return F.struct(F.when(ahead, col(range_from)).otherwise(col(prior_from)).alias("from"), F.when(ahead, col(range_to)).otherwise(col(prior_to)).alias("to"))


def repaired_state(body) -> Column:
    """A persisted sync state from its JSON: what isn't sound is left out or takes its default."""
    s = F.from_json(col(body), "struct<appliedFinancialEventDigests: array<string>, lastSuccessfulTo: string, lookbackDays: string, refreshOverlapDays: string, recordsDigest: string>")
    digest = "^[a-f0-9]{64}$"
    whole = lambda c, default: F.coalesce(F.when(c.rlike("^[1-9][0-9]*$"), c.try_cast("int")), F.lit(default))
    return F.struct(
        F.filter(F.coalesce(s["appliedFinancialEventDigests"], F.array().cast("array<string>")), lambda d: F.coalesce(d.rlike(digest), F.lit(False))).alias("applied"),
        F.try_to_timestamp(s["lastSuccessfulTo"]).alias("last_to"),
        whole(s["lookbackDays"], 730).alias("lookback_days"),
        whole(s["refreshOverlapDays"], 14).alias("overlap_days"),
        F.when(s["recordsDigest"].rlike(digest), s["recordsDigest"]).alias("records_digest"),
    )


def comparable_count(pages) -> Column:
    """Total of the search page that fits best: the first named by artist and title, else the first."""
    good = F.filter(pages, lambda p: p["label"].isin("expanded artist/title", "discogs artist/title"))
    return F.coalesce(F.get(good, F.lit(0))["total"], F.get(pages, F.lit(0))["total"])
