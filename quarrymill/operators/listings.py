"""Operators over listing tables: lanes with counted rejects, work queues, recheck pages, snapshot merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import best_per_key


def lanes(rows: DataFrame, lane: str, item: str, price: str, reject: Column, order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(candidates, rejects): accepted rows once for each item with the least price and all lanes that found it; rejects counted by lane and reason."""
    judged = rows.withColumn("reject", reject)
    good = judged.where("reject IS NULL").drop("reject")
    best = best_per_key(good, [item], [F.col(price).asc_nulls_last(), *order]).drop(lane)
    found = good.groupBy(item).agg(F.array_sort(F.collect_set(lane)).alias("lanes"))  # at most one entry for each lane
    return best.join(found, item), judged.where("reject IS NOT NULL").groupBy(lane, "reject").agg(F.count(F.lit(1)).alias("n"))


def work_queue(finds: DataFrame, key: str, due: Column) -> DataFrame:
    """One entry for each search key: how many finds wait for it, whether any is due, the first of them."""
    return finds.groupBy(key).agg(F.count(F.lit(1)).alias("finds"), F.bool_or(due).alias("due"), F.min("id").alias("first_id"))


def recheck_pages(ledger: DataFrame, source: str, url: str, priority: Column, seen: str, k: int = 4) -> DataFrame:
    """The k pages of each source that are looked at again: best priority, then most recent; each page once."""
    from .ranking import top_per_key

    once = best_per_key(ledger.withColumn("_p", priority), [source, url], [F.desc("_p"), F.desc(seen)])
    return top_per_key(once, [source], [F.desc("_p"), F.desc(seen), F.col(url)], k).select(source, url, "rank")


def snapshot_merge(rows: DataFrame, current: DataFrame, key: str, title: str, values: list[str]) -> DataFrame:
    """rows with the values of the current row of the same key, else of the only current row of the same title."""
    by_key = current.where(F.col(key).isNotNull()).select(key, *[F.col(v).alias(f"_k_{v}") for v in values]).dropDuplicates([key])
    by_title = current.groupBy(title).agg(F.count(F.lit(1)).alias("_n"), *[F.min(v).alias(f"_t_{v}") for v in values]).where("_n = 1").drop("_n")
    out = rows.join(by_key, key, "left").join(by_title, title, "left")
    return out.select(*rows.columns, *[F.coalesce(f"_k_{v}", f"_t_{v}").alias(v) for v in values])


def either_key(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], left_id: str, right_id: str) -> DataFrame:
    """Pairs of rows equal in any of several keys: a union of equi-joins, each pair once."""
    parts = [left.select(left_id, F.col(a).alias("_k")).join(right.select(right_id, F.col(b).alias("_k")), "_k").select(left_id, right_id) for a, b in pairs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def aliased(history: DataFrame, campaigns: DataFrame, campaign: str, merged: str) -> DataFrame:
    """History whose campaign ids are replaced by the campaign they were merged into."""
    names = campaigns.select(F.explode(merged).alias("_old"), F.col(campaign).alias("_new")).where("_old <> _new").groupBy("_old").agg(F.min("_new").alias("_new"))
    return history.join(names, history[campaign] == names["_old"], "left").withColumn(campaign, F.coalesce("_new", campaign)).drop("_old", "_new")


def latest_final(runs: DataFrame, phase: str = "phase", created: str = "created_at") -> DataFrame:
    """The most recent final run; no final run, no row."""
    return runs.where(F.lower(F.col(phase)) == "final").orderBy(F.desc(created), *[c for c in runs.columns if c not in (phase, created)][:1]).limit(1)


def prune_stale(feedback: DataFrame, current: DataFrame, key: str, guard: str) -> DataFrame:
    """Feedback without the entries whose offer is there with another key of observation."""
    moved = feedback.select(key, F.col(guard).alias("_was")).join(current.select(key, F.col(guard).alias("_now")), key).where("_was <> _now").select(key).distinct()
    return feedback.join(moved, key, "left_anti")
