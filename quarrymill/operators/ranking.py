"""Ranking, deduplication, top-k, allocation and diversity-capped selection."""

from __future__ import annotations

import math
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given total order (row_number = 1 becomes a group limit before the shuffle)."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top_per_key(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def first_wins(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The row seen first for each key, by an explicit ordinal."""
    return best_per_key(rows, keys, [F.col(ordinal)])


def merged_best(rows: DataFrame, keys: list[str], order: list[Column], filled: list[str]) -> DataFrame:
    """The best row of each key; its nulls in `filled` are taken from the best other row that has a value."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    ranked = rows.withColumn("_r", F.row_number().over(rank))
    best = ranked.where("_r = 1").drop("_r", *filled)
    values = ranked.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_r"))).alias(c) for c in filled])
    return best.join(values, keys)


def round_robin(rows: DataFrame, lane: str, order: list[Column], limit: int) -> DataFrame:
    """The first of every lane, then the second, and so on up to the limit."""
    turn = F.row_number().over(Window.partitionBy(lane).orderBy(*order))
    return rows.withColumn("turn", turn).where(F.col("turn") <= limit).orderBy("turn", lane).limit(limit)


def allocate(rows: DataFrame, keys: list[str], weight: str, amount: str, order: list[Column], out: str = "allocated") -> DataFrame:
    """Deal an amount of whole cents over the rows of a key by weight: each share rounded, the last row takes the rest."""
    all_rows = Window.partitionBy(*keys)
    line = all_rows.orderBy(*order)
    share = F.floor(F.col(amount) * F.col(weight) / F.sum(weight).over(all_rows) + 0.5).cast("long")
    dealt = rows.withColumns({"_share": share, "_last": F.row_number().over(line) == F.count(F.lit(1)).over(all_rows)})
    before = F.coalesce(F.sum("_share").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.withColumn(out, F.when(F.col("_last"), F.col(amount).cast("long") - before).otherwise(F.col("_share"))).drop("_share", "_last")


def diversity_select(rows: DataFrame, limit: int, source: str = "source", family: str = "family", score: str = "score", tie: str = "id", per_source: int | None = None, per_family: int | None = None, keep_share: float = 0.2) -> DataFrame:
    """Pick `limit` rows in five passes under caps for sources and families; adds `phase`.

    Each pick depends on the counts before it, so the picking is one sequential pass. Only rows that it could take
    reach it: at most `per_source` rows of every source, by rank. That is exact, because the source cap holds in
    every pass and a row further down its source is never taken before one above it; which rows stand among the
    first `keep_share` of the limit, and so are protected, is told from all rows."""
    order = [F.desc(score), F.col(tie)]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(source).alias("s"), F.count_distinct(family).alias("f")).first()
    limit = min(limit, stats.n)
    source_cap = per_source or max(min(5, limit), math.ceil(limit * 0.2), math.ceil(limit / max(1, stats.s)))
    family_cap = max(1, per_family or 0, math.ceil(limit * 0.5), math.ceil(limit / max(1, stats.f)))
    keep = math.ceil(limit * keep_share)
    if limit == stats.n:
        return rows.withColumn("phase", F.lit("ranked_fill"))
    ranked = top_per_key(rows, [source], order, source_cap, "_in_source")
    protected = {r[0] for r in rows.orderBy(*order).limit(keep).select(tie).collect()}  # a fifth of the limit
    schema = rows.schema.simpleString()[7:-1] + ",phase:string"

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([score, tie], ascending=[False, True], kind="stable").drop(columns=["_in_source", "_one"]).reset_index(drop=True)
        sources, families = frame[source].tolist(), frame[family].tolist()
        phase: dict[int, str] = {}
        by_source: dict = {}
        by_family: dict = {}

        def add(i: int, name: str, capped: bool) -> bool:
            if i in phase or len(phase) >= limit or by_source.get(sources[i], 0) >= source_cap or capped and by_family.get(families[i], 0) >= family_cap:
                return False
            phase[i] = name
            by_source[sources[i]] = by_source.get(sources[i], 0) + 1
            by_family[families[i]] = by_family.get(families[i], 0) + 1
            return True

        everyone = range(len(frame))
        ties = frame[tie].tolist()
        for i in everyone:
            if ties[i] in protected:
                add(i, "protected_quality", True)
        for i in everyone:
            if families[i] not in by_family:
                add(i, "family_representation", True)
        for capped in (True, False):
            for i in everyone:
                if sources[i] not in by_source:
                    add(i, "source_representation", capped)
        for name, capped in (("ranked_fill", True), ("family_cap_relaxation", False)):
            for i in everyone:
                add(i, name, capped)
        taken = sorted(phase)
        return frame.loc[taken].assign(phase=[phase[i] for i in taken])

    return ranked.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(pick, schema)


def dedupe_by(rows: DataFrame, identity: Column, priority: Column, tie: list[Column]) -> DataFrame:
    """Highest priority for each identity; identity and priority are the caller's expressions."""
    return best_per_key(rows.withColumn("_id", identity), ["_id"], [priority.desc(), *tie]).drop("_id")


