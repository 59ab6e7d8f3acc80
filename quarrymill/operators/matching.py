"""Joins and matching: token index, attribution cascade, campaigns, exclusions, range merge, transitive identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import round_half_up
from .components import connected_components
from .ranking import best_per_key


def token_match(queries: DataFrame, items: DataFrame, query_id: str, item_id: str, words: str, k: int = 3, least: float = 0.65, bonus: str | None = None, min_words: int = 2) -> DataFrame:
    """The k best items of each query by shared words over the larger word set, through an inverted index.

    Equal word sets are one entry on either side, so a name that repeats a thousand times is matched once; the k
    best items of an entry are ranked before entries are expanded."""
    dist = lambda f, i: f.select(F.col(i).alias("_id"), F.array_sort(F.array_distinct(words)).alias("_w"), *([F.col(bonus).alias("_b")] if bonus and i == item_id else []))
    q, c = dist(queries, query_id), dist(items, item_id)
    q_sets, c_sets = (f.where(F.size("_w") > 0).select("_w").distinct() for f in (q, c))
    left = q_sets.where(F.size("_w") >= min_words).select(F.col("_w").alias("qw"), F.explode("_w").alias("t"))
    right = c_sets.select(F.col("_w").alias("cw"), F.explode("_w").alias("t"))
    shared = left.join(right, "t").groupBy("qw", "cw").agg(F.count(F.lit(1)).alias("shared"))
    scored = shared.withColumn("score", F.col("shared") / F.greatest(F.size("qw"), F.size("cw")).cast("double"))
    top = c.withColumn("_r", F.row_number().over(Window.partitionBy("_w").orderBy(*([F.desc("_b")] if bonus else []), "_id"))).where(F.col("_r") <= k + 1)
    pairs = q.join(scored, q["_w"] == scored["qw"]).join(top.select(F.col("_id").alias(item_id), F.col("_w").alias("cw"), *([F.col("_b")] if bonus else [])), "cw")
    pairs = pairs.withColumn("score", F.col("score") + F.col("_b") if bonus else F.col("score")).where(F.col("score") >= least).select(F.col("_id").alias(query_id), item_id, round_half_up("score", 4).alias("score"))
    best = Window.partitionBy(query_id).orderBy(F.desc("score"), item_id)
    return pairs.where(F.col(query_id) != F.col(item_id)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def unique_lookup(rows: DataFrame, index: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """rows with `value` of the index row whose key matches, only where exactly one row does."""
    single = index.where(F.col(right).isNotNull()).groupBy(F.col(right).alias(left)).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias(value)).where("_n = 1").drop("_n")
    return rows.join(single, left, "left")


def attribution_cascade(transactions: DataFrame, lines: DataFrame) -> DataFrame:
    """Target of each transaction: the exact line, else the order, else the only line of its item; in that priority, currencies equal.

    transactions: txn_id, order_id, line_id, item_id, currency; lines: order_id, line_id, item_id, currency."""
    exact = lines.select("order_id", "line_id", "currency", F.lit(1).alias("_line")).distinct()
    orders = lines.groupBy("order_id", "currency").agg(F.count(F.lit(1)).alias("_order"))
    items = lines.groupBy("item_id", "currency").agg(F.count(F.lit(1)).alias("_item"), F.min("line_id").alias("item_line"), F.min("order_id").alias("item_order")).where("_item = 1")
    found = transactions.join(exact, ["order_id", "line_id", "currency"], "left").join(orders, ["order_id", "currency"], "left").join(items, ["item_id", "currency"], "left")
    level = F.when(F.col("_line").isNotNull(), "line").when(F.col("_order").isNotNull(), "order").when(F.col("_item").isNotNull(), "item").otherwise("none")
    return found.withColumn("target", level).select(*[F.col(c) for c in transactions.columns], "target", F.when(F.col("target") == "item", F.col("item_order")).when(F.col("target") != "none", F.col("order_id")).alias("target_order"), F.when(F.col("target") == "line", F.col("line_id")).when(F.col("target") == "item", F.col("item_line")).alias("target_line"))


def apply_campaigns(items: DataFrame, campaigns: DataFrame, item_id: str, price: str) -> DataFrame:
    """The best applicable campaign of each item's source: its own collection before a sitewide one, then the larger discount.

    Campaigns are ranked before they meet items, so an item meets one of its collection and one row of its source, however many campaigns a source has."""
    order = [F.col("discount").desc_nulls_last(), F.col("campaign_id").asc_nulls_last()]
    offer = F.struct("campaign_id", "discount")
    named = campaigns.where("source IS NOT NULL")
    own = best_per_key(named.where("scope_value IS NOT NULL"), ["source", "scope_value"], order).select("source", F.col("scope_value").alias("collection"), offer.alias("_own"))
    wide = best_per_key(named.where("scope = 'sitewide'"), ["source"], order).select("source", offer.alias("_wide"))
    # The best of any scope applies to nothing; it only decides between rows of one item that no campaign applies to.
    of_source = best_per_key(named, ["source"], order).select("source", offer.alias("_any")).join(wide, "source", "left")
    joined = items.join(own, ["source", "collection"], "left").join(of_source, "source", "left").withColumn("_offer", F.coalesce("_own", "_wide"))
    first = F.coalesce("_offer", "_any")
    rank = [F.col("_offer").isNotNull().desc(), F.col("_own").isNotNull().desc(), first["discount"].desc_nulls_last(), first["campaign_id"].asc_nulls_last()]
    best = best_per_key(joined, [item_id], rank)
    return best.select(item_id, "source", price, F.col("_offer.campaign_id").alias("campaign_id"), F.when(F.col("_offer").isNotNull(), round_half_up(F.col(price) * (1 - F.col("_offer.discount") / 100.0))).otherwise(F.col(price)).alias("offer_price"))


def exclude_shared(rows: DataFrame, others: DataFrame, keys: list[Column], other_keys: list[Column]) -> DataFrame:
    """Rows that share none of several keys with any other row: anti join on the exploded keys, one equi-join."""
    tagged = rows.withColumn("_row", F.monotonically_increasing_id())
    labelled = lambda ks: F.explode(F.array_compact(F.array(*[F.when(k.isNotNull(), F.concat(F.lit(f"{i}:"), k.cast("string"))) for i, k in enumerate(ks)])))
    hit = tagged.select("_row", labelled(keys).alias("_k")).join(others.select(labelled(other_keys).alias("_k")).distinct(), "_k", "left_semi").select("_row").distinct()
    return tagged.join(hit, "_row", "left_anti").drop("_row")


def baseline_union(fresh: DataFrame, baseline: DataFrame, keys: list[list[str]]) -> DataFrame:
    """Fresh rows and those baseline rows that share none of the composite keys with them."""
    rest = baseline
    for k in keys:
        rest = rest.join(fresh.where(" AND ".join(f"{c} IS NOT NULL" for c in k)).select(*k).distinct(), k, "left_anti")
    return fresh.unionByName(rest)


def range_replace(existing: DataFrame, fresh: DataFrame, key: list[str], day: str, first, last, keep: list[str]) -> DataFrame:
    """Upsert of a refreshed range: fresh rows win but keep columns in `keep` of the old row where they have none; old rows inside the
    range that are missing from fresh are deleted, those outside stay."""
    old = existing.select(*key, *[F.col(c).alias(f"_old_{c}") for c in existing.columns if c not in key], F.lit(True).alias("_was"))
    new = fresh.withColumn("_is", F.lit(True))
    both = old.join(new, key, "full_outer")
    inside = F.col(f"_old_{day}").between(F.lit(first), F.lit(last))
    both = both.where(F.col("_is") | (F.col("_was") & ~inside))
    value = lambda c: F.when(F.col("_is"), F.coalesce(F.col(c), F.col(f"_old_{c}")) if c in keep else F.col(c)).otherwise(F.col(f"_old_{c}"))
    return both.select(*key, *[value(c).alias(c) for c in existing.columns if c not in key])


def carried_over(current: DataFrame, incoming: DataFrame, key: str, guard: str, state: str) -> DataFrame:
    """Incoming rows with the state of the current row of the same key, where its guard is unchanged."""
    old = current.select(key, F.col(guard).alias("_guard"), F.col(state).alias("_state"))
    return incoming.join(old, key, "left").withColumn(state, F.when(F.col("_guard").eqNullSafe(F.col(guard)), F.col("_state"))).drop("_guard", "_state")


def transitive_groups(rows: DataFrame, row_id: str, keys: list[str]) -> DataFrame:
    """row_id and group (least row_id): rows that share any key value, transitively; null keys join nothing.

    Each row is linked with the least row of each of its key values, so a value that a million rows share gives a million links and no
    pairs; the links' connected components are the groups."""
    named = F.explode(F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)])))
    held = rows.select(F.col(row_id).cast("long").alias("a"), named.alias("k"))
    least = held.groupBy("k").agg(F.min("a").alias("b"))
    labels = connected_components(held.join(least, "k").select("a", "b"))
    out = rows.select(row_id).distinct().join(labels, F.col(row_id) == F.col("node"), "left")
    return out.select(row_id, F.coalesce("label", F.col(row_id).cast("long")).alias("group"))


def merge_products(rows: DataFrame, group: str = "group") -> DataFrame:
    """One product of each group: least price, regular price above it, first known ids by row order, availability as true before false before unknown."""
    least = rows.withColumn("_least", F.min("price").over(Window.partitionBy(group)))
    return least.groupBy(group).agg(
        F.count(F.lit(1)).alias("offers"),
        F.min("price").alias("price"),
        F.max(F.when(F.col("regular") > F.col("_least"), F.col("regular"))).alias("regular_price"),
        F.min_by("gtin", F.when(F.col("gtin").isNotNull(), F.col("row_id"))).alias("gtin"),
        F.min_by("title", F.struct((-F.length("title")).alias("n"), "row_id")).alias("title"),
        F.coalesce(F.max(F.when(F.col("available"), True)), F.min(F.col("available"))).alias("available"),
    )
