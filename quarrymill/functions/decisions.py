"""Decision rules as Column expressions: cost ledger, buy decision, triage, seller pricing, bulk buying, run quality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import clamp, col, half_dollar_down, known_amount, ratio, round_half_up, round_plain

# Default costs and thresholds of the buy decision.
SETTINGS = {
    "tax_percent": 9.5, "inbound": 5.0, "duty": 0.0, "fx": 0.0, "other_acquisition": 0.0, "fee_rate": 0.15, "fee_fixed": 0.3,
    "promoted_rate": 0.02, "returns_rate": 0.03, "returns_amount": 0.0, "outbound": 6.0, "packaging": 1.0, "other_selling": 0.0,
    "fast_net": 4.0, "fast_roi": 0.2, "fast_days": 45, "balanced_net": 7.0, "balanced_roi": 0.3, "balanced_days": 120,
    "high_net": 12.0, "high_roi": 0.5, "high_days": 270, "max_active": 50, "min_resale": 10.0, "buy_score": 65, "test_score": 50,
    "watch_net": 5.0, "watch_roi": 0.15,
}


def chosen(rules: list[tuple[Column, object]], otherwise=None) -> Column:
    """First rule that holds."""
    value = lambda v: v if isinstance(v, Column) else F.lit(v)
    return reduce(lambda c, r: c.when(r[0], value(r[1])), rules[1:], F.when(rules[0][0], value(rules[0][1]))).otherwise(value(otherwise))


def cost_ledger(price, resale, settings: dict | None = None, costs: dict[str, Column] | None = None) -> dict[str, Column]:
    """Every line of the ledger, each part rounded to cents before it is added. costs: known amounts that replace defaults."""
    s, costs = SETTINGS | (settings or {}), costs or {}
    given = lambda name: round_half_up(F.coalesce(known_amount(costs[name]), F.lit(s[name])) if name in costs else F.lit(s[name]))
    money = round_half_up
    price, resale = F.coalesce(known_amount(price), F.lit(0.0)), known_amount(resale)
    tax = F.coalesce(known_amount(costs["tax"]), money(price * (s["tax_percent"] / 100))) if "tax" in costs else money(price * (s["tax_percent"] / 100))
    landed = money(price + tax + given("inbound") + given("duty") + given("fx") + given("other_acquisition"))
    fee = F.coalesce(money(resale * s["fee_rate"] + s["fee_fixed"]), F.lit(0.0))
    promoted = F.coalesce(money(resale * s["promoted_rate"]), F.lit(0.0))
    returns = F.coalesce(money(resale * s["returns_rate"] + s["returns_amount"]), F.lit(s["returns_amount"]))
    selling = money(fee + promoted + given("outbound") + given("packaging") + returns + given("other_selling"))
    total = money(landed + selling)
    net = money(resale - total)
    return {"sales_tax": tax, "landed_cost": landed, "marketplace_fee": fee, "promoted_fee": promoted, "returns_reserve": returns, "selling_costs": selling, "total_cost": total, "net_profit": net, "roi_ratio": ratio(net, landed), "margin_ratio": ratio(net, resale)}


def with_ledger(frame, price: str, resale: str, settings: dict | None = None):
    """frame with the ledger's columns, one projection after another so that no expression is repeated."""
    s = SETTINGS | (settings or {})
    p, r = F.coalesce(known_amount(price), F.lit(0.0)), known_amount(resale)
    frame = frame.withColumns({"sales_tax": round_half_up(p * (s["tax_percent"] / 100)), "marketplace_fee": F.coalesce(round_half_up(r * s["fee_rate"] + s["fee_fixed"]), F.lit(0.0)), "promoted_fee": F.coalesce(round_half_up(r * s["promoted_rate"]), F.lit(0.0)), "returns_reserve": F.coalesce(round_half_up(r * s["returns_rate"] + s["returns_amount"]), F.lit(s["returns_amount"]))})
    frame = frame.withColumns({"landed_cost": round_half_up(p + F.col("sales_tax") + s["inbound"] + s["duty"] + s["fx"] + s["other_acquisition"]), "selling_costs": round_half_up(F.col("marketplace_fee") + F.col("promoted_fee") + s["outbound"] + s["packaging"] + F.col("returns_reserve") + s["other_selling"])})
    frame = frame.withColumn("total_cost", round_half_up(F.col("landed_cost") + F.col("selling_costs"))).withColumn("net_profit", round_half_up(r - F.col("total_cost")))
    return frame.withColumns({"roi_ratio": ratio("net_profit", "landed_cost"), "margin_ratio": ratio("net_profit", r)})


def max_purchase_price(resale, min_net: float = 7.0, min_roi: float = 0.3, settings: dict | None = None) -> Column:
    """Largest price in cents at which profit and return still hold: bisection over the monotone ledger, 40 halvings."""

    def passes(price: Column) -> Column:
        ledger = cost_ledger(price, resale, settings)
        return F.coalesce((ledger["net_profit"] >= min_net) & (ledger["roi_ratio"] >= min_roi), F.lit(False))

    def halve(a: Column, _: Column) -> Column:
        middle = (a["low"] + a["high"]) / 2
        good = passes(middle)
        return F.struct(F.when(good, middle).otherwise(a["low"]).alias("low"), F.when(good, a["high"]).otherwise(middle).alias("high"))

    start = F.struct(F.lit(0.0).alias("low"), F.greatest(F.lit(0.0), col(resale)).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda a: F.floor(a["low"] * 100) / 100.0)
    return F.when(passes(found), found).otherwise(0.0)


def days_to_sell(active, supply_months, demand) -> Column:
    """A week where nothing competes and there is demand, else thirty days a month of supply, a week at least."""
    months = col(supply_months)
    return F.when((col(active) == 0) & col(demand), 7.0).when(months.isNotNull(), F.greatest(F.lit(7.0), F.floor(months * 30 + 0.5).cast("double")))


def with_market(frame, units_90: str, units_365: str, units_1095: str, active: str):
    """Velocity and supply: sell-through, sales a month, months of supply, long-term sales, days to sell."""
    frame = frame.withColumns({"sell_through": ratio(col(units_90), col(units_90) + col(active)), "sales_per_month": round_half_up(col(units_90) / 3.0), "long_term_per_month": round_half_up(col(units_1095) / 36.0)})
    frame = frame.withColumn("supply_months", F.when(F.col("sales_per_month") > 0, round_half_up(col(active) / F.col("sales_per_month"))))
    return frame.withColumn("days_to_sell", days_to_sell(active, "supply_months", col(units_90) > 0))


def strategies(net, roi, units_90, units_365, sales, sell_through, last_sale_age, long_term, days, s: dict = SETTINGS) -> dict[str, Column]:
    """Which of the three strategies a find is eligible for."""
    fresh = lambda n: F.coalesce(col(last_sale_age) <= n, F.lit(False))
    gains = lambda a, b, most: (col(net) >= a) & (col(roi) >= b) & F.coalesce(col(days) <= most, F.lit(False))
    return {
        "fast_turn": (col(units_90) >= 6) & (col(sales) >= 2) & fresh(45) & (col(sell_through) >= 0.3) & gains(s["fast_net"], s["fast_roi"], s["fast_days"]),
        "balanced": (col(units_90) >= 3) & (col(sales) >= 1) & fresh(60) & (col(sell_through) >= 0.2) & gains(s["balanced_net"], s["balanced_roi"], s["balanced_days"]),
        "high_margin": (col(units_365) >= 6) & fresh(120) & F.coalesce(col(long_term) >= 0.15, F.lit(True)) & gains(s["high_net"], s["high_roi"], s["high_days"]),
    }


def priority_score(net, roi, profit_30, sales, units_365, long_term, last_sale_age, supply_months, active) -> Column:
    """Demand 30, economics 30, supply 20 points (evergreen and evidence points come from the caller's own evidence)."""
    part = lambda x, weight, top: clamp(F.coalesce(col(x).cast("double"), F.lit(0.0)) * weight / top, 0, weight)
    recency = chosen([(col(last_sale_age) <= 30, 4.0), (col(last_sale_age) <= 60, 3.0), (col(last_sale_age) <= 120, 2.0), (col(last_sale_age) <= 365, 1.0)], 0.0)
    demand = F.least(F.lit(30.0), part(sales, 12.0, 4.0) + part(units_365, 8.0, 12.0) + clamp(F.coalesce(col(long_term), F.lit(0.0)) * 6.0, 0, 6) + recency)
    economics = F.least(F.lit(30.0), part(net, 20.0, 12.0) + part(roi, 8.0, 0.6) + part(profit_30, 2.0, 8.0))
    months = col(supply_months)
    supply = chosen([(col(units_365) <= 0, 0.0), (col(active) == 0, 20.0), (months <= 1, 20.0), (months <= 3, 17.0), (months <= 6, 13.0), (months <= 12, 8.0), (months <= 24, 3.0)], 0.0)
    return F.floor(demand + economics + supply + 0.5)


def band(score) -> Column:
    return chosen([(col(score) >= 80, "A"), (col(score) >= 65, "B"), (col(score) >= 50, "C")], "D")


def buy_decision(net, roi, active, days, score, eligible, watch, resale, missing) -> Column:
    """REJECT, REVIEW, BUY or WATCH: hard fails, then missing evidence, then strategy and score, then watch."""
    return chosen(
        [
            (F.coalesce((col(net) < 0) | (col(roi) < 0), F.lit(False)), "REJECT"),
            (F.coalesce((col(active) > SETTINGS["max_active"]) & (col(days) > SETTINGS["high_days"]), F.lit(False)), "REJECT"),
            (missing, "REVIEW"),
            (eligible & (col(score) >= SETTINGS["buy_score"]), "BUY"),
            (eligible & (col(score) >= SETTINGS["test_score"]), "REVIEW"),
            (eligible, "WATCH"),
            (watch & (col(resale) >= SETTINGS["min_resale"]), "WATCH"),
        ],
        "REJECT",
    )


def triage_confidence(n, cluster_ratio, flags, spread, threshold: float = 5.0) -> Column:
    raw = F.least(col(n) / 6.0, F.lit(1.0)) * 0.35 + col(cluster_ratio) * 0.35 + 0.25 - F.least(col(flags) * 0.08, F.lit(0.24)) - F.when(col(spread) > 4 * threshold, 0.2).otherwise(0.0)
    return clamp(raw, 0, 1)


def triage(benchmark, n, cluster_ratio, flags, spread, outliers, confidence, sales_median=None, guide=None, shown_median=None, threshold: float = 5.0) -> dict[str, Column]:
    """decision and confidence of a search: GREEN sells above the threshold, RED doesn't, YELLOW needs a look."""
    none = F.lit(None).cast("double")
    sales, guide, shown = (none if x is None else col(x) for x in (sales_median, guide, shown_median))
    b, c = col(benchmark), col(confidence)
    conflict = (sales <= threshold) & (b > threshold)
    guide_conflict = sales.isNull() & (guide <= threshold) & (b > threshold)
    strong = (b > threshold) & (col(n) >= 4)
    weak = (col(n) >= 4) & (col(cluster_ratio) >= 0.7) & (col(spread) <= 4 * threshold) & (col(outliers) == 0) & (col(flags) == 0) & (b <= threshold) & (c >= 0.72)
    low = F.least(c, F.lit(0.68))
    return {
        "decision": chosen([(shown > threshold, "GREEN"), (shown.isNotNull(), "RED"), (b.isNull(), "YELLOW"), (conflict | F.coalesce(guide_conflict, F.lit(False)), "YELLOW"), (strong, "GREEN"), (weak, "RED")], "YELLOW"),
        "confidence": chosen([(shown.isNotNull(), 1.0), (b.isNull(), 0.0), (conflict | F.coalesce(guide_conflict, F.lit(False)), low), (strong, F.greatest(c, F.when(col(cluster_ratio) >= 0.7, 0.72).otherwise(0.62)))], c),
    }


def seller_status(price, benchmark, comparables, active) -> dict[str, Column]:
    """delta_value, delta_percent and status of an own listing against the market."""
    enough = (col(comparables) >= 4) & col(benchmark).isNotNull()
    value = F.when(enough, round_plain(col(price) - col(benchmark)))
    percent = F.when(enough, round_plain(value / col(benchmark) * 100))
    status = chosen([(~F.coalesce(enough, F.lit(False)) | (col(comparables) < 10), "NEEDS_REVIEW"), ((percent > 25) & (col(active) >= 150), "VERY_CROWDED"), ((percent > 25) & (col(active) >= 50), "CROWDED"), (percent > 25, "PRICE_HIGH"), (percent < -20, "PRICE_LOW")], "OK")
    return {"delta_value": value, "delta_percent": percent, "status": status}


def bulk_buy(median, cheapest_ten=None, guide_median=None, matches=None) -> dict[str, Column]:
    """Buy and sale price, fees, tax and profit of a bulk purchase, in half dollars."""
    m = col(median)
    n = F.coalesce(col(matches), F.lit(0)) if matches is not None else F.lit(0)
    ten = col(cheapest_ten) if cheapest_ten is not None else F.lit(None).cast("double")
    guide = F.coalesce(col(guide_median), m) if guide_median is not None else m
    buy = F.when(m < 5, 0.5).otherwise(half_dollar_down(m * 0.4))
    sale = half_dollar_down(chosen([((n > 50) & ten.isNotNull(), ten * 0.7), (n > 10, guide * 0.8)], m * 1.1))
    fees = half_dollar_down(sale * 0.1825)
    before = sale - buy - fees - 1
    tax = half_dollar_down(F.greatest(F.lit(0.0), before) * 0.153)
    return {"buy_price": buy, "sale_price": sale, "fees": fees, "pre_tax": before, "tax": tax, "profit": half_dollar_down(before - tax), "category": chosen([(m < 5, "under_5"), (m <= 25, "5_to_25")], "over_25")}


def quality_score(embedded, metadata, original, price, sold_price, sold_shipping, units_90, artist_units) -> Column:
    """Rank score of a candidate from parser confidence, markdown, margin, demand and price tier."""
    p = col(price)
    whole = lambda x: F.floor(x + 0.5).cast("double")
    zero = F.lit(0.0)
    base = F.coalesce(col(embedded) * 0.35, col(metadata).cast("double"), zero)
    markdown = F.when(col(original) > p, F.least(F.lit(20.0), whole((col(original) - p) / col(original) * 40))).otherwise(zero)
    margin = F.when(col(sold_price) > 0, clamp(whole((col(sold_price) + F.coalesce(col(sold_shipping), zero) - p) * 1.5), -20, 30))
    demand = F.when(col(units_90) > 0, F.least(F.lit(12.0), F.log2(F.lit(1.0) + col(units_90)) * 3))
    artist = chosen([(col(artist_units) >= 20, 25.0), (col(artist_units) >= 10, 20.0), (col(artist_units) >= 5, 14.0), (col(artist_units) >= 2, 7.0)], 0.0)
    tier = chosen([(p <= 13, 12.0), (p <= 15, 9.0), (p <= 20, 5.0), (p > 35, -15.0), (p > 25, -10.0), (p.isNotNull(), -5.0)], 0.0)
    return base + markdown + F.coalesce(margin, zero) + F.coalesce(demand, zero) + artist + tier


def metadata_score(priority, likelihood, noise, kind) -> Column:
    points = F.coalesce(F.greatest(F.lit(0), F.lit(5) - col(priority)) * 4, F.lit(0))
    return points + chosen([(col(likelihood) == "high", 8), (col(likelihood) == "medium", 4)], 0) + chosen([(col(noise) == "low", 4), (col(noise) == "high", -6)], 0) + F.when(col(kind) == "deal-aggregator", -4).otherwise(0)


def run_status(direct, catalog_coverage, productive, sale_coverage, blocked, parser_empty) -> dict[str, Column]:
    """blocked, degraded or healthy, and whether a run may be published."""
    stop = F.coalesce((col(direct) == 0) | (col(catalog_coverage) < 0.70) | (col(productive) < 0.30), F.lit(True))
    weak = (col(catalog_coverage) < 0.85) | (col(productive) < 0.40) | (col(sale_coverage) < 0.45) | (col(blocked) > 0) | (col(parser_empty) > 0)
    return {"status": chosen([(stop, "blocked"), (weak, "degraded")], "healthy"), "publishable": ~stop}


def record_economics(paid, financial_refund, fulfilment_refund, quantity) -> dict[str, Column]:
    """Refund, its share of what was paid, and the units that stay sold: none where the refund is as good as whole."""
    p, a, b = (F.coalesce(col(c), F.lit(0.0)) for c in (paid, financial_refund, fulfilment_refund))
    refund = F.greatest(a, b)
    whole = (a >= p * 0.95) | ((a == 0) & (b >= p * 0.8))
    return {"refund_amount": round_half_up(refund), "refund_rate": F.when(p > 0, round_plain(F.least(F.lit(1.0), refund / p), 4)).otherwise(0.0), "retained": F.when(whole, 0).otherwise(F.greatest(F.lit(1), F.floor(col(quantity)))).cast("long")}


def charge_class(kind, fee_type, memo) -> Column:
    """Class of a financial charge, from its type, fee type and memo."""
    signal = F.upper(F.concat_ws(" ", col(fee_type), col(memo)))
    # Names of fees that marketplaces charge for selling and for advertising.
    selling = "FINAL_VALUE|FIXED_PER_ORDER|INTERNATIONAL_FEE|REGULATORY_OPERATING|INSERTION_FEE|BELOW_STANDARD|HIGH_ITEM_NOT_AS_DESCRIBED"
    return chosen([(col(kind) == "SHIPPING_LABEL", "shipping_label"), (signal.rlike(r"\bAD[_ ]FEE\b|PROMOTED|ADVERTIS"), "advertising"), (signal.rlike(selling), "selling_fee")], "other")


def offer_type(text, percent, code) -> Column:
    """Kind of a sale offer, the first that fits."""
    t = F.lower(F.coalesce(col(text), F.lit("")))
    says = lambda p: t.rlike(p)
    # The words of each kind of offer.
    return chosen(
        [
            (says(r"\b(?:bogo|buy\s+(?:one|1)\s+get\s+(?:one|1)|(?:2|two)\s+for\s+(?:1|one))\b"), "bogo"),
            (says(r"\bbuy\s+more\s+save\s+more\b|\bspend\s+\$?\d+\s+(?:get|save)\b"), "volume"),
            (col(code).isNotNull() | says(r"\b(?:coupon|promo(?:tional)?\s+code|discount\s+code|use\s+code)\b"), "coupon"),
            (col(percent).isNotNull(), "percent-sale"),
            (says(r"\bgarage[- ]sale\b"), "garage-sale"),
            (says(r"\bwarehouse[- ](?:overstock|sale)\b|\boverstock[- ]sale\b"), "warehouse-overstock"),
            (says(r"\b(?:clearance|closeout|overstock|final\s+sale)\b"), "clearance"),
        ],
        "sale",
    )


def discount_qualifier(text, percent) -> Column:
    return chosen([(col(percent).isNull(), "none"), (F.lower(col(text)).rlike(r"\bup\s+to\b"), "up_to")], "exact")
