"""Evaluation of a find: evidence, cost ledger, market, three strategies, priority, gates, decision and its reason codes.

`evaluate` takes finds with these columns; those that a frame lacks count as null:
  id, artist, condition, barcode, sku, purchase_price, lowest_active_price, source_currency, source_country, conversion_rate,
  conversion_at, captured_at, offer_verification, preference, artist_units_365, artist_units_1095, external_evergreen,
  best_seller, customer_pick, review_count, source_min_net, source_min_roi, average_sold_price, average_sold_shipping,
  costs     struct of known amounts that replace defaults (see COSTS),
  sold      struct of structured evidence (see SOLD), legacy_sold the same from unstructured fields: used where sold is null, never validated,
  active    struct of structured evidence (see ACTIVE), legacy_active likewise,
  research  array<struct<average_price, average_shipping, total_sold>>: sales that stand in for a missing resale price.

Cases: an unknown currency or one without a fresh conversion withholds profit and return; unknown numbers are null and never zero;
ages of moments more than five minutes ahead are unknown; evidence without a date is stale. Everything happens within a row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.decisions import chosen
from ..functions.money import age_in_days, clamp, confidence, currency_code, currency_of_country, known_amount, positive_amount, ratio, round_half_up, scaled

# Defaults of the cost ledger, floors of the strategies and limits of the gates.
SETTINGS = {
    "tax_percent": 9.5, "inbound_shipping": 5.0, "duty": 0.0, "fx_fees": 0.0, "other_acquisition": 0.0, "fee_rate": 0.15, "fee_fixed": 0.3, "promoted_rate": 0.02,
    "outbound_shipping": 6.0, "packaging": 1.0, "returns_rate": 0.03, "returns_amount": 0.0, "other_selling": 0.0,
    "fast_net": 4.0, "fast_roi": 0.2, "fast_days": 45, "balanced_net": 7.0, "balanced_roi": 0.3, "balanced_days": 120, "high_net": 12.0, "high_roi": 0.5, "high_days": 270,
    "max_active": 50, "max_supply_months": 6, "max_sale_age": 60, "max_evidence_age": 30, "max_offer_age": 2, "min_resale": 10.0, "min_confidence": 0.8,
    "min_sales_per_month": 1.0, "min_sell_through": 0.2, "min_units_90": 3, "buy_score": 65, "test_score": 50,
}
COSTS = ["tax_percent", "tax_amount", "inbound_shipping", "duty", "fx_fees", "other_acquisition", "fee_rate", "fee_fixed", "promoted_rate", "outbound_shipping", "packaging", "returns_rate", "returns_amount", "other_selling"]
SOLD = {
    "captured_at": "timestamp", "condition": "string", "resale_price": "double", "price_p25": "double", "latest_sale": "date", "sale_age": "double", "match_confidence": "string",
    "sales_per_month": "double", "source": "string", "status": "string", "velocity": "string", "units_30": "double", "units_90": "double", "units_365": "double", "units_1095": "double",
}
ACTIVE = {"captured_at": "timestamp", "exact_count": "double", "match_confidence": "string", "complete": "boolean", "status": "string"}
_PLAIN = {
    "id": "long", "artist": "string", "condition": "string", "barcode": "string", "sku": "string", "purchase_price": "double", "lowest_active_price": "double", "source_currency": "string", "source_country": "string",
    "conversion_rate": "double", "conversion_at": "timestamp", "captured_at": "timestamp", "offer_verification": "string", "preference": "string", "artist_units_365": "double", "artist_units_1095": "double",
    "external_evergreen": "double", "best_seller": "boolean", "customer_pick": "boolean", "review_count": "double", "source_min_net": "double", "source_min_roi": "double",
    "average_sold_price": "double", "average_sold_shipping": "double",
}


def find_schema() -> str:
    """The columns of a find, as a schema string."""
    struct = lambda fields: "struct<" + ", ".join(f"{k}: {v}" for k, v in fields.items()) + ">"
    parts = [f"{k} {v}" for k, v in _PLAIN.items()] + [f"costs {struct(dict.fromkeys(COSTS, 'double'))}"]
    parts += [f"{k} {struct(SOLD)}" for k in ("sold", "legacy_sold")] + [f"{k} {struct(ACTIVE)}" for k in ("active", "legacy_active")]
    return ", ".join([*parts, "research array<struct<average_price: double, average_shipping: double, total_sold: double>>"])


def _complete(finds: DataFrame) -> DataFrame:
    """The columns of a find, with nulls for those that aren't there."""
    schema = T.StructType.fromDDL(find_schema())
    have = {f.name: f.dataType for f in finds.schema.fields}

    def column(f: T.StructField) -> Column:
        if f.name not in have:
            return F.lit(None).cast(f.dataType)
        if isinstance(f.dataType, T.StructType):
            given = set(have[f.name].names)
            made = F.struct(*[(F.col(f"{f.name}.{g.name}") if g.name in given else F.lit(None)).cast(g.dataType).alias(g.name) for g in f.dataType.fields])
            return F.when(F.col(f.name).isNotNull(), made)
        return F.col(f.name).cast(f.dataType)

    return finds.select(*[column(f).alias(f.name) for f in schema.fields])


def expected_condition(condition) -> Column:
    """Condition that sold evidence has to have for a listing's condition."""
    c = F.lower(F.coalesce(F.col(condition), F.lit("")))
    return F.when(c.rlike(r"\b(?:new|sealed|factory sealed|brand new)\b"), "new_sealed").when(c.rlike(r"\b(?:used|vg|good|fair|poor|nm|near mint)\b"), "used").otherwise("unknown")


def weighted_quarter(rows) -> Column:
    """Nearest-rank first quartile of what research rows were sold for with shipping, weighted by units; null where no row has a price."""
    priced = F.filter(rows, lambda r: known_amount(r["average_price"]).isNotNull())
    total = lambda r: round_half_up(r["average_price"] + F.coalesce(known_amount(r["average_shipping"]), F.lit(0.0)))
    units = lambda r: F.greatest(F.lit(1.0), F.floor(F.coalesce(known_amount(r["total_sold"]), F.lit(1.0))).cast("double"))
    order = F.array_sort(F.transform(priced, lambda r: F.struct(total(r).alias("value"), units(r).alias("units"))))
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("value"))
    whole = F.aggregate(order, F.lit(0.0), lambda a, r: a + r["units"])
    least = F.greatest(F.lit(1.0), F.ceil(whole * 0.25).cast("double"))
    step = lambda a, r: F.struct((a["seen"] + r["units"]).alias("seen"), F.when(a["value"].isNull() & (a["seen"] + r["units"] >= least), r["value"]).otherwise(a["value"]).alias("value"))
    return F.aggregate(order, start, step, lambda a: a["value"])


def with_evidence(finds: DataFrame, now: str, s: dict) -> DataFrame:
    """Sold and active evidence, resale price, currency and the price that the ledger takes."""
    at = F.lit(now).cast("timestamp")
    f = _complete(finds).withColumns({"_s": F.coalesce("sold", "legacy_sold"), "_a": F.coalesce("active", "legacy_active"), "_structured": F.col("sold").isNotNull(), "_at": at})
    f = f.withColumns(
        {
            "units_30": known_amount("_s.units_30"), "units_90": known_amount("_s.units_90"), "units_365": known_amount("_s.units_365"), "units_1095": known_amount("_s.units_1095"),
            "sold_confidence": confidence("_s.match_confidence"), "active_confidence": confidence("_a.match_confidence"),
            "exact_count": known_amount("_a.exact_count"),
            "sale_age": F.when(F.col("_s.latest_sale").isNotNull(), age_in_days(F.col("_s.latest_sale").cast("timestamp"), "_at").cast("double")).otherwise(known_amount("_s.sale_age")),
            "sold_age": age_in_days("_s.captured_at", "_at"), "active_age": age_in_days("_a.captured_at", "_at"), "offer_age": age_in_days("captured_at", "_at"), "_conversion_age": age_in_days("conversion_at", "_at"),
            "resale_price": F.coalesce(known_amount("_s.resale_price"), known_amount("_s.price_p25"), weighted_quarter(F.col("research")),
                                       F.when(~F.col("_structured"), round_half_up((known_amount("average_sold_price") + F.coalesce(known_amount("average_sold_shipping"), F.lit(0.0))) * 0.85))),
            "currency": F.coalesce(currency_code("source_currency"), currency_of_country("source_country")),
            "lowest_active": positive_amount("lowest_active_price"),
        }
    )
    f = f.withColumns(
        {
            "velocity_validated": F.col("_structured") & F.col("units_90").isNotNull() & F.coalesce((F.col("_s.velocity") == "dated_transactions") | (F.col("_s.source") == "local-own-sales-history"), F.lit(False)),
            "_velocity": F.coalesce(round_half_up(F.col("units_90") / 3), known_amount("_s.sales_per_month")),
            "_converted": round_half_up(known_amount("purchase_price") * positive_amount("conversion_rate")),
            "condition_matches": F.coalesce(F.col("_s.condition"), F.lit("unknown")) == expected_condition("condition"),
        }
    )
    fresh = F.coalesce(F.col("_converted").isNotNull() & (F.col("_conversion_age") <= s["max_evidence_age"]), F.lit(False))
    foreign = F.col("currency") != "USD"
    return f.withColumns({"conversion_required": F.col("currency").isNull() | (foreign & ~fresh), "ledger_price": F.coalesce(known_amount(F.when(foreign & fresh, F.col("_converted")).otherwise(F.col("purchase_price"))), F.lit(0.0))})


def with_costs(f: DataFrame, s: dict) -> DataFrame:
    """The ledger's lines; profit and return are null where the resale price is unknown or withheld."""
    known = lambda name: known_amount(f"costs.{name}")
    amount = lambda name: round_half_up(F.coalesce(known(name), F.lit(s[name])))
    rate = lambda name: round_half_up(F.least(F.lit(1.0), F.coalesce(known(name), F.lit(s[name]))), 6)
    f = f.withColumn("_resale", F.when(~F.col("conversion_required"), F.col("resale_price")))
    f = f.withColumns(
        {
            "sales_tax": F.coalesce(known("tax_amount"), round_half_up(F.col("ledger_price") * (F.coalesce(known("tax_percent"), F.lit(s["tax_percent"])) / 100))),
            "marketplace_fee": F.coalesce(round_half_up(F.col("_resale") * rate("fee_rate") + amount("fee_fixed")), F.lit(0.0)),
            "promoted_fee": F.coalesce(round_half_up(F.col("_resale") * rate("promoted_rate")), F.lit(0.0)),
            "returns_reserve": F.coalesce(round_half_up(F.col("_resale") * rate("returns_rate") + amount("returns_amount")), amount("returns_amount")),
        }
    )
    landed = F.col("ledger_price") + F.col("sales_tax") + amount("inbound_shipping") + amount("duty") + amount("fx_fees") + amount("other_acquisition")
    selling = F.col("marketplace_fee") + F.col("promoted_fee") + amount("outbound_shipping") + amount("packaging") + F.col("returns_reserve") + amount("other_selling")
    f = f.withColumns({"landed_cost": round_half_up(landed), "selling_costs": round_half_up(selling)})
    f = f.withColumn("total_cost", round_half_up(F.col("landed_cost") + F.col("selling_costs")))
    f = f.withColumn("net_profit", round_half_up(F.col("_resale") - F.col("total_cost")))
    return f.withColumns({"roi": ratio("net_profit", "landed_cost"), "margin": ratio("net_profit", "_resale")})


def with_market(f: DataFrame) -> DataFrame:
    """Sell-through, velocity, months of supply, days to sell and profit per thirty days."""
    both = F.col("units_90") + F.col("exact_count")
    f = f.withColumns(
        {
            "sell_through": F.when(both > 0, round_half_up(F.col("units_90") / both, 4)).when(both == 0, 0.0),
            "sales_per_month": F.col("_velocity"),
            "long_per_month": round_half_up(F.col("units_1095") / 36),
        }
    )
    f = f.withColumns(
        {
            "supply_months": F.when(F.col("sales_per_month") > 0, round_half_up(F.col("exact_count") / F.col("sales_per_month"))),
            "long_supply_months": F.when(F.col("long_per_month") > 0, round_half_up(F.col("exact_count") / F.col("long_per_month"))),
        }
    )
    months = F.coalesce("supply_months", "long_supply_months")
    demand = F.coalesce(F.col("sales_per_month") > 0, F.lit(False)) | F.coalesce(F.col("long_per_month") > 0, F.lit(False))
    f = f.withColumn("days_to_sell", F.when((F.col("exact_count") == 0) & demand, 7.0).when(months.isNotNull(), F.greatest(F.lit(7.0), F.floor(months * 30 + 0.5).cast("double"))))
    return f.withColumn("profit_per_30", round_half_up(F.col("net_profit") * (30 / F.col("days_to_sell"))))


def with_evergreen(f: DataFrame) -> DataFrame:
    """Level of evergreen support: strong from two points, moderate from one."""
    year, three = (F.coalesce(known_amount(c), F.lit(0.0)) for c in ("artist_units_365", "artist_units_1095"))
    outside = clamp(F.coalesce(known_amount("external_evergreen"), F.lit(0.0)), 0, 1)
    points = (
        chosen([(year >= 20, 2), (year >= 8, 1)], 0)
        + chosen([(three >= 60, 2), (three >= 24, 1)], 0)
        + F.when((F.col("units_1095") >= 24) & (F.col("long_per_month") >= 0.67), 2).otherwise(0)
        + chosen([(outside >= 0.8, 2), (outside >= 0.5, 1)], 0)
        + F.when(F.col("preference") == "prefer", 1).otherwise(0)
    )
    return f.withColumn("evergreen", chosen([(points >= 2, "strong"), (points >= 1, "moderate")], "none"))


def with_gates(f: DataFrame, s: dict) -> DataFrame:
    """The gates that don't depend on a strategy."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    f = f.withColumns(
        {
            "market_fresh": yes((F.col("sold_age") <= s["max_evidence_age"]) & (F.col("active_age") <= s["max_evidence_age"])),
            "offer_fresh": yes(F.col("offer_age") <= s["max_offer_age"]),
            "offer_verified": F.lower(F.trim(F.coalesce("offer_verification", F.lit("")))).isin("direct_retailer", "official_api"),
            "sold_evidence": yes(F.col("_s.status") == "validated") & F.col("units_90").isNotNull() & F.col("_s.latest_sale").isNotNull() & F.col("velocity_validated") & F.col("condition_matches"),
            "active_evidence": yes(F.col("_a.status").isin("available", "no_results")) & yes(F.col("_a.complete")) & F.col("exact_count").isNotNull(),
            "confident": (F.col("sold_confidence") >= s["min_confidence"]) & (F.col("active_confidence") >= s["min_confidence"]),
        }
    )
    ready = F.col("sold_evidence") & F.col("confident") & F.col("market_fresh") & F.col("offer_fresh") & ~F.col("conversion_required") & yes(F.col("resale_price") >= s["min_resale"])
    supply = yes((F.col("exact_count") <= s["max_active"]) & (F.col("days_to_sell") <= s["high_days"]))
    return f.withColumns({"evidence_ready": ready, "supply": supply})


STRATEGIES = ["fast_turn", "balanced", "high_margin"]


def with_strategies(f: DataFrame, s: dict) -> DataFrame:
    """For each strategy its floors and whether demand and economics hold, and whether it is worth watching: a struct column each."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    c, valid = F.col, F.col("velocity_validated")
    quick = (c("units_90") >= max(6, s["min_units_90"] * 2)) & (c("sales_per_month") >= max(2, s["min_sales_per_month"] * 2)) & (c("sale_age") <= min(45, s["max_sale_age"])) & (c("sell_through") >= max(0.3, s["min_sell_through"])) & (c("days_to_sell") <= s["fast_days"])
    steady = (c("units_90") >= s["min_units_90"]) & (c("sales_per_month") >= s["min_sales_per_month"]) & (c("sale_age") <= s["max_sale_age"]) & (c("sell_through") >= s["min_sell_through"]) & (c("days_to_sell") <= s["balanced_days"])
    turn = F.coalesce(c("days_to_sell") <= s["high_days"], c("long_supply_months") * 30 <= s["high_days"])
    slow = (c("units_365") >= max(6, s["min_units_90"] * 2)) & (c("sale_age") <= max(120, s["max_sale_age"])) & turn & (c("long_per_month").isNull() | (c("long_per_month") >= 0.15))
    partly = (c("sale_age") <= 365) & (yes(c("units_365") >= 1) | (c("evergreen") == "strong")) & (c("days_to_sell") <= s["high_days"] * 2)
    f = f.withColumns({"_quick": valid & yes(quick), "_steady": valid & yes(steady), "_slow": valid & yes(slow), "_partly": valid & yes(partly)})
    flexible = c("_steady") & ~c("_quick") & (c("evergreen") == "strong") & yes(c("supply_months") <= min(3, s["max_supply_months"]))
    lagging = yes(c("days_to_sell") > s["balanced_days"]) | yes(c("supply_months") > s["max_supply_months"])
    net, roi = F.greatest(F.lit(s["high_net"]), F.coalesce(known_amount("source_min_net"), F.lit(0.0))), F.greatest(F.lit(s["high_roi"]), F.coalesce(known_amount("source_min_roi"), F.lit(0.0)))
    extra = lagging & (c("evergreen") == "none")
    floors = {
        "fast_turn": (F.lit(s["fast_net"]), F.lit(s["fast_roi"]), c("_quick"), F.lit(False)),
        "balanced": (
            F.when(flexible, float(round(max(s["fast_net"], s["balanced_net"] * 0.8), 2))).otherwise(s["balanced_net"]),
            F.when(flexible, float(round(max(s["fast_roi"], s["balanced_roi"] * 0.8), 4))).otherwise(s["balanced_roi"]),
            c("_steady"),
            F.lit(False),
        ),
        "high_margin": (
            round_half_up(net + F.when(lagging, 2.0).otherwise(0.0) + F.when(extra, 1.0).otherwise(0.0)),
            round_half_up(roi + F.when(lagging, 0.05).otherwise(0.0) + F.when(extra, 0.05).otherwise(0.0), 4),
            c("_slow"),
            c("_partly"),
        ),
    }
    f = f.withColumns({f"_{k}": F.struct(n.alias("min_net"), r.alias("min_roi"), d.alias("demand"), p.alias("partial")) for k, (n, r, d, p) in floors.items()})
    for k in STRATEGIES:
        x = lambda name, k=k: F.col(f"_{k}.{name}")
        good = yes((c("net_profit") >= x("min_net")) & (c("roi") >= x("min_roi")))
        near = yes((c("net_profit") >= F.greatest(F.lit(0.0), x("min_net") * 0.75)) & (c("roi") >= x("min_roi") * 0.75))
        watch = c("evidence_ready") & yes(c("net_profit") >= 0) & ((x("demand") & ~good) | (~x("demand") & x("partial") & (good | near)))
        f = f.withColumn(k, F.struct(x("min_net").alias("min_net"), x("min_roi").alias("min_roi"), x("demand").alias("demand"), good.alias("economics"), (c("evidence_ready") & x("demand") & good).alias("eligible"), watch.alias("watch")))
    which = lambda part: chosen([(F.col(f"{k}.{part}"), k) for k in STRATEGIES])
    some = lambda part: F.col(f"fast_turn.{part}") | F.col(f"balanced.{part}") | F.col(f"high_margin.{part}")
    return f.withColumns({"strategy": which("eligible"), "demand": some("demand"), "economics": some("economics"), "_watch": which("watch")})


def with_priority(f: DataFrame) -> DataFrame:
    """Points for demand (30), economics (30), supply (20), evergreen support (15) and evidence (5), their sum and its band."""
    c = F.col
    part = lambda x, top, weight: clamp(scaled(known_amount(x), 0, top) * weight, 0, weight)
    recent = F.coalesce(chosen([(c("sale_age") <= 30, 4.0), (c("sale_age") <= 60, 3.0), (c("sale_age") <= 120, 2.0), (c("sale_age") <= 365, 1.0)], 0.0), F.lit(0.0))
    selling = c("sold_evidence") & (F.coalesce(c("sales_per_month") > 0, F.lit(False)) | F.coalesce(c("long_per_month") > 0, F.lit(False)))
    months = F.coalesce("supply_months", "long_supply_months")
    stock = chosen([(c("exact_count") == 0, 20.0), (months <= 1, 20.0), (months <= 3, 17.0), (months <= 6, 13.0), (months <= 12, 8.0), (months <= 24, 3.0)], 0.0)
    outside = clamp(F.coalesce(known_amount("external_evergreen"), F.lit(0.0)), 0, 1)
    reviews = clamp(F.log10(F.lit(1.0) + F.coalesce(known_amount("review_count"), F.lit(0.0))) / 3, 0, 0.5)
    liked = F.when(F.coalesce("best_seller", F.lit(False)) | F.coalesce("customer_pick", F.lit(False)), 1.5).otherwise(0.0)
    one = lambda x: x.cast("int")
    has_code = (F.coalesce("barcode", F.lit("")) != "") | (F.coalesce("sku", F.lit("")) != "")
    f = f.withColumns(
        {
            "points_demand": clamp(round_half_up(part("sales_per_month", 4, 12) + part("units_365", 12, 8) + part("long_per_month", 1, 6) + recent, 1), 0, 30),
            "points_economics": F.when(c("conversion_required"), 0.0).otherwise(clamp(round_half_up(part("net_profit", 12, 20) + part("roi", 0.6, 8) + part("profit_per_30", 8, 2), 1), 0, 30)),
            "points_supply": F.when(selling, stock).otherwise(0.0),
            "points_evergreen": clamp(round_half_up(part("artist_units_365", 20, 6) + part("artist_units_1095", 60, 2) + part("long_per_month", 1, 4) + liked + reviews + outside * 4 + F.when(c("preference") == "prefer", 5.0).otherwise(0.0), 1), 0, 15),
            "points_evidence": (one(c("sold_evidence")) + one(c("active_evidence")) + one(c("confident")) + one(c("market_fresh") & c("offer_fresh")) + one(has_code)).cast("double"),
        }
    )
    score = F.floor(c("points_supply") + c("points_demand") + c("points_economics") + c("points_evergreen") + c("points_evidence") + 0.5)
    unknown = F.lower(F.trim(F.coalesce("artist", F.lit("")))).rlike("^unknown artist$")
    score = F.when(unknown, F.greatest(F.lit(0), score - 3)).otherwise(score)
    score = F.when(c("conversion_required"), F.greatest(F.lit(0), score - 3)).otherwise(score)
    f = f.withColumn("avoided", F.coalesce(c("preference") == "avoid", F.lit(False)))
    f = f.withColumn("score", F.when(c("avoided"), F.least(score, F.lit(49))).otherwise(score).cast("long"))
    return f.withColumn("band", chosen([(c("score") >= 80, "A"), (c("score") >= 65, "B"), (c("score") >= 50, "C")], "REJECT"))


def with_ceiling(f: DataFrame, s: dict) -> DataFrame:
    """The highest price in cents at which a strategy that has demand, or is watched, still holds: null where the resale price is withheld.

    What is left falls with the price, so halving the cents up to the resale price finds it."""
    known = lambda name: known_amount(f"costs.{name}")
    amount = lambda name: round_half_up(F.coalesce(known(name), F.lit(s[name])))
    fixed = amount("inbound_shipping") + amount("duty") + amount("fx_fees") + amount("other_acquisition")
    f = f.withColumns({"_tax": F.coalesce(known("tax_percent"), F.lit(s["tax_percent"])) / 100, "_given_tax": known("tax_amount"), "_fixed": fixed})

    def passes(price: Column, k: str) -> Column:
        landed = round_half_up(price + F.coalesce(F.col("_given_tax"), round_half_up(price * F.col("_tax"))) + F.col("_fixed"))
        net = round_half_up(F.col("_resale") - round_half_up(landed + F.col("selling_costs")))
        return F.coalesce((net >= F.col(f"{k}.min_net")) & (ratio(net, landed) >= F.col(f"{k}.min_roi")), F.lit(False))

    def ceiling(k: str) -> Column:
        def halve(a: Column, _: Column) -> Column:
            middle = F.floor((a["low"] + a["high"]) / 2)
            good = passes(middle / 100.0, k)
            return F.struct(F.when(good, middle).otherwise(a["low"]).alias("low"), F.when(good, a["high"]).otherwise(middle).alias("high"))

        most = F.floor(F.col("_resale") * 100) + 1
        start = F.struct(F.lit(0).cast("long").alias("low"), most.alias("high"))
        halvings = F.sequence(F.lit(1), F.ceil(F.log2(most.cast("double"))).cast("int") + 1)
        return F.aggregate(halvings, start, halve, lambda a: a["low"] / 100.0)

    f = f.withColumns({f"_top_{k}": F.when(F.col("_resale").isNotNull() & (F.col(f"{k}.demand") | F.col(f"{k}.watch")), ceiling(k)) for k in STRATEGIES})
    best = F.greatest(F.lit(0.0), *[F.when(passes(F.col(f"_top_{k}"), k), F.col(f"_top_{k}")) for k in STRATEGIES])
    return f.withColumn("max_price", F.when(F.col("_resale").isNotNull(), best))


def with_decision(f: DataFrame, s: dict) -> DataFrame:
    """BUY, WATCH, REVIEW or REJECT, and the codes that say why."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    codes = lambda rules: F.filter(F.array(*[F.when(r, F.lit(n)) for r, n in rules]), lambda x: x.isNotNull())
    loses = ~c("conversion_required") & yes((c("net_profit") < 0) | (c("roi") < 0))
    crowded = c("active_evidence") & c("sold_evidence") & yes((c("exact_count") > s["max_active"]) & (c("days_to_sell") > s["high_days"]))
    undercut = ~c("conversion_required") & c("active_evidence") & (c("active_confidence") >= s["min_confidence"]) & yes(c("lowest_active") <= c("ledger_price"))
    stale = [(~c("market_fresh"), "EVIDENCE_STALE_OR_UNDATED"), (~c("offer_fresh"), "OFFER_STALE_OR_UNDATED")]
    f = f.withColumns(
        {
            "_hard": codes([(loses, "ECONOMICS_HARD_FAIL"), (crowded, "SUPPLY_HARD_FAIL"), (undercut, "ACTIVE_MARKET_BELOW_BUY_COST")]),
            "_stale": codes(stale),
            "_missing": codes(
                [
                    (c("currency").isNull(), "SOURCE_CURRENCY_UNKNOWN"),
                    (c("currency").isNotNull() & c("conversion_required"), "SOURCE_CURRENCY_UNCONVERTED"),
                    (~c("sold_evidence"), "SOLD_EVIDENCE_INCOMPLETE"),
                    (~c("velocity_validated"), "SOLD_VELOCITY_UNVALIDATED"),
                    (~c("active_evidence"), "ACTIVE_EVIDENCE_INCOMPLETE"),
                    *stale,
                    (~c("offer_verified"), "ACQUISITION_OFFER_UNVERIFIED"),
                    (~c("condition_matches"), "SOLD_CONDITION_MISMATCH"),
                    (c("sold_confidence") < s["min_confidence"], "SOLD_MATCH_CONFIDENCE_LOW"),
                    (c("active_confidence") < s["min_confidence"], "ACTIVE_MATCH_CONFIDENCE_LOW"),
                    (c("resale_price").isNull(), "CONSERVATIVE_RESALE_MISSING"),
                ]
            ),
            "_failed": codes([(~c("demand"), "DEMAND_GATE_FAILED"), (~c("supply"), "SUPPLY_GATE_FAILED"), (~c("economics"), "ECONOMICS_GATE_FAILED"), (~c("confident"), "MATCH_CONFIDENCE_GATE_FAILED")]),
        }
    )
    mismatch = ((c("sold_confidence") > 0) & (c("sold_confidence") < 0.5)) | ((c("active_confidence") > 0) & (c("active_confidence") < 0.5))
    watched = c("_watch").isNotNull() & c("confident") & yes(c("resale_price") >= s["min_resale"]) & yes(c("max_price") > 0)
    strategy = F.concat(F.lit("STRATEGY_"), F.upper("strategy"))
    watch_demand = chosen([(c("_watch") == k, F.col(f"{k}.demand")) for k in STRATEGIES], False)
    outcome = lambda decision, why: F.struct(F.lit(decision).alias("decision"), why.alias("codes")) if isinstance(decision, str) else F.struct(decision.alias("decision"), why.alias("codes"))
    verdict = chosen(
        [
            (F.size("_hard") > 0, outcome("REJECT", F.concat("_hard", "_stale"))),
            (c("avoided"), outcome("REJECT", F.array(F.lit("USER_AVOID_PREFERENCE")))),
            (F.size("_missing") > 0, outcome(F.when(mismatch, "REJECT").otherwise("REVIEW"), c("_missing"))),
            (c("strategy").isNotNull() & (c("score") >= s["buy_score"]), outcome("BUY", F.array(F.lit("ADAPTIVE_STRATEGY_PASSED"), strategy))),
            (c("strategy").isNotNull() & (c("score") >= s["test_score"]), outcome("REVIEW", F.array(F.lit("TEST_ONE_OPTION"), strategy))),
            (c("strategy").isNotNull(), outcome("WATCH", F.array(F.lit("LOW_PRIORITY_WATCH"), strategy))),
            (watched, outcome("WATCH", F.concat("_failed", F.array(F.when(watch_demand, "PRICE_TARGET_WATCH").otherwise("SLOW_DEMAND_HIGH_MARGIN_WATCH"))))),
        ],
        outcome("REJECT", c("_failed")),
    )
    return f.withColumn("_verdict", verdict).withColumns({"decision": F.col("_verdict.decision"), "reason_codes": F.array_join("_verdict.codes", ",")})


RESULT = [
    "id", "decision", "reason_codes", "score", "band", "strategy", "net_profit", "roi", "margin", "landed_cost", "selling_costs", "total_cost", "sell_through", "sales_per_month", "supply_months", "long_per_month", "long_supply_months",
    "days_to_sell", "profit_per_30", "max_price", "evergreen", "points_demand", "points_economics", "points_supply", "points_evergreen", "points_evidence", "active_evidence", "demand", "economics", "confident", "market_fresh", "offer_fresh",
    "offer_verified", "sold_evidence", "supply", "conversion_required",
]


def evaluate(finds: DataFrame, now: str, settings: dict | None = None) -> DataFrame:
    """Every find with its decision, reason codes (comma-joined, in order), score, gates and the numbers behind them."""
    s = SETTINGS | (settings or {})
    f = with_market(with_costs(with_evidence(finds, now, s), s))
    f = with_priority(with_strategies(with_gates(with_evergreen(f), s), s))
    return with_decision(with_ceiling(f, s), s).select(*RESULT)
