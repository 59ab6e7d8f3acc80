"""Campaign lifecycle and exactly-once events, as batch joins of a ledger and as streams over the same transition function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.decisions import chosen

LEDGER = "campaign string, content string, status string, scans int, consecutive int, misses int, failures int, last_seen string"
EVERGREEN_AFTER, END_AFTER = 5, 2


def content_hash(*columns: str) -> Column:
    """sha256 of the named values as JSON with sorted keys; unknown values are left out."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256)


def campaign_id(*columns: str) -> Column:
    """Id of a campaign from its terms: hashed as a JSON array, so neither a separator in a term nor a missing one makes two campaigns equal."""
    return F.concat(F.lit("campaign-"), F.substring(F.sha2(F.to_json(F.array(*[F.col(c).cast("string") for c in columns])), 256), 1, 20))


def reconcile(ledger: DataFrame, seen: DataFrame, health: DataFrame | None = None, run: str | None = None) -> DataFrame:
    """One run of the lifecycle: the next ledger, with the transition's reason.

    ledger: LEDGER columns; seen: campaign, content (one row each); health: campaign, checked (true, false, or no row for no report)."""
    old = ledger.select("campaign", *[F.col(c).alias(f"_{c}") for c in ("content", "status", "scans", "consecutive", "misses", "failures", "last_seen")])
    both = old.join(seen.select("campaign", "content", F.lit(True).alias("seen")), "campaign", "full_outer")
    both = both.join(health.select("campaign", "checked"), "campaign", "left") if health is not None else both.withColumn("checked", F.lit(True))
    now, prior, fresh = F.coalesce("seen", F.lit(False)), F.col("_status"), F.col("_status").isNull() | (F.col("_status") == "ended")
    steady = (F.col("_misses") == 0) & (F.col("_failures") == 0)
    streak = F.when(fresh, 1).when(steady, F.col("_consecutive") + 1).otherwise(1)
    missed = F.col("_misses") + 1
    scans = F.coalesce("_scans", F.lit(0)) + F.when(now, 1).otherwise(0)
    status = chosen(
        [
            (now & fresh, "new"),
            (now & (F.col("_content") != F.col("content")), "changed"),
            (now & (streak >= EVERGREEN_AFTER), "evergreen"),
            (now, "ongoing"),
            (prior == "ended", "ended"),
            (F.col("checked").isNull(), prior),
            (~F.col("checked"), "unknown"),
            (missed >= END_AFTER, "ended"),
            ((F.col("_scans") >= EVERGREEN_AFTER) | (prior == "evergreen"), "evergreen"),
        ],
        "ongoing",
    )
    idle = ~now & (F.coalesce(prior == "ended", F.lit(False)) | F.col("checked").isNull())
    out = both.select(
        "campaign",
        F.coalesce("content", "_content").alias("content"),
        status.alias("status"),
        scans.cast("int").alias("scans"),
        F.when(now, streak).otherwise(F.col("_consecutive")).cast("int").alias("consecutive"),
        F.when(now, 0).when(idle | ~F.coalesce("checked", F.lit(True)), F.col("_misses")).otherwise(missed).cast("int").alias("misses"),
        F.when(now, 0).when(idle, F.col("_failures")).when(~F.coalesce("checked", F.lit(True)), F.col("_failures") + 1).otherwise(0).cast("int").alias("failures"),
        F.when(now, F.lit(run)).otherwise(F.col("_last_seen")).cast("string").alias("last_seen"),
        prior.alias("from_status"),
    )
    reason = chosen([(F.col("from_status").isNull(), "first_seen"), ((F.col("from_status") == "ended") & (F.col("status") == "new"), "reopened"), (F.col("status") == "changed", "content_changed"), (F.col("status") == "unknown", "check_failed"), (F.col("status") == "ended", "not_found"), (F.col("from_status") == F.col("status"), "unchanged")], "seen_again")
    return out.withColumn("reason", reason)


def history(step: DataFrame, run: str) -> DataFrame:
    """One row for each change of status, with a hashed id."""
    moved = step.where(~F.col("from_status").eqNullSafe(F.col("status")))
    return moved.select(F.sha2(F.concat_ws("|", "campaign", F.lit(run), "status"), 256).alias("id"), "campaign", F.lit(run).alias("run"), "from_status", F.col("status").alias("to_status"), "reason")


def advance(state: tuple | None, content: str | None, run: str) -> tuple:
    """The same transition for one campaign whose page was checked: (content, status, scans, consecutive, misses, failures, last_seen)."""
    if state is None:
        return (content, "new", 1, 1, 0, 0, run)
    was, status, scans, streak, misses, failures, last = state
    if content is None:
        if status == "ended":
            return state
        misses += 1
        status = "ended" if misses >= END_AFTER else "evergreen" if scans >= EVERGREEN_AFTER or status == "evergreen" else "ongoing"
        return (was, status, scans, streak, misses, 0, last)
    if status == "ended":
        return (content, "new", scans + 1, 1, 0, 0, run)
    streak = streak + 1 if misses == 0 and failures == 0 else 1
    status = "changed" if content != was else "evergreen" if streak >= EVERGREEN_AFTER else "ongoing"
    return (content, status, scans + 1, streak, 0, 0, run)


def replay(observations: DataFrame, runs: list[str]) -> DataFrame:
    """Status of every campaign after every run from its first sighting on: `advance` as a fold over the runs, inside the JVM.

    observations: campaign, run, content (one row each). A campaign's runs are a bounded list (the given runs), so one campaign fits a task."""
    start = F.struct(F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("status"), *[F.lit(0).alias(c) for c in ("scans", "consecutive", "misses")], F.array().cast("array<struct<run: string, status: string, scans: int, consecutive: int, misses: int>>").alias("out"))

    def step(a: Column, run: Column) -> Column:
        content = F.try_element_at(F.col("_seen"), run)
        now, fresh = content.isNotNull(), a["status"].isNull()
        reopened = fresh | (a["status"] == "ended")
        over = ~now & (a["status"] == "ended")
        streak = F.when(reopened, 1).when(a["misses"] == 0, a["consecutive"] + 1).otherwise(1)
        missed = a["misses"] + 1
        status = chosen(
            [
                (~now & fresh, None),
                (now & reopened, "new"),
                (now & (a["content"] != content), "changed"),
                (now & (streak >= EVERGREEN_AFTER), "evergreen"),
                (now, "ongoing"),
                (over | (missed >= END_AFTER), "ended"),
                ((a["scans"] >= EVERGREEN_AFTER) | (a["status"] == "evergreen"), "evergreen"),
            ],
            "ongoing",
        )
        scans, consecutive = a["scans"] + F.when(now, 1).otherwise(0), F.when(now, streak).otherwise(a["consecutive"])
        misses = F.when(now | fresh, 0).when(over, a["misses"]).otherwise(missed)
        row = F.struct(run.alias("run"), status.alias("status"), scans.alias("scans"), consecutive.alias("consecutive"), misses.alias("misses"))
        return F.struct(F.coalesce(content, a["content"]).alias("content"), status.alias("status"), scans.alias("scans"), consecutive.alias("consecutive"), misses.alias("misses"), F.concat(a["out"], F.array(row)).alias("out"))

    given = F.array(*[F.lit(r) for r in runs]) if runs else F.array().cast("array<string>")
    seen = observations.where(F.col("run").isin(runs)).groupBy("campaign").agg(F.map_from_entries(F.collect_list(F.struct("run", "content"))).alias("_seen"))
    states = seen.select("campaign", F.explode(F.aggregate(given, start, step, lambda a: a["out"])).alias("s"))
    return states.where("s.status IS NOT NULL").select("campaign", "s.run", "s.status", "s.scans", "s.consecutive", "s.misses")


def replay_stream(observations: DataFrame) -> DataFrame:
    """The lifecycle over a stream of (campaign, run_no int, content): a run is reached when any row of it arrives, and runs between are misses."""
    state_schema = "content string, status string, scans int, consecutive int, misses int, failures int, last_seen string, run_no int"

    def each(key, frames: Iterator[pd.DataFrame], state):
        now = state.get if state.exists else None
        held = None if now is None else tuple(now[:7])
        at = -1 if now is None else now[7]
        out = []
        for r in sorted((r for f in frames for r in f.itertuples(index=False)), key=lambda r: r.run_no):
            while held is not None and at + 1 < r.run_no:
                at += 1
                held = advance(held, None, str(at))
                out.append((key[0], at, held[1]))
            if r.run_no > at:
                at = r.run_no
                held = advance(held, r.content, str(at))
                out.append((key[0], at, held[1]))
        if held is not None:
            state.update((*held, at))
        yield pd.DataFrame(out, columns=["campaign", "run_no", "status"])

    return observations.groupBy("campaign").applyInPandasWithState(each, "campaign string, run_no int, status string", state_schema, "append", "NoTimeout")


def apply_once(events: DataFrame, applied: DataFrame, key: str, digest: str) -> DataFrame:
    """Events not applied yet. The same key with another digest, in the state or among the events, is an error and stops the job."""
    per_key = events.groupBy(key).agg(F.min(digest).alias("_low"), F.max(digest).alias("_high"))
    checked = events.join(per_key, key).join(applied.select(key, F.col(digest).alias("_applied")), key, "left")
    clash = (F.col("_low") != F.col("_high")) | (F.col("_applied") != F.col(digest))
    sound = F.when(F.coalesce(clash, F.lit(False)), F.raise_error(F.concat(F.lit("event has new content: "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.col("_applied").isNull())
    fresh = checked.where(sound).drop("_applied", "_low", "_high")
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(digest))).where("_n = 1").drop("_n")


def corrections(events: DataFrame, applied: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose content has changed since it was applied: the state has to be rebuilt."""
    return events.select(key, digest).distinct().join(applied.select(key, F.col(digest).alias("_applied")), key).where(F.col(digest) != F.col("_applied")).select(key)


def dedupe_stream(events: DataFrame, key: str, time: str, late: str = "14 days") -> DataFrame:
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def sync_range(last_to: Column, now: Column) -> Column:
    """struct<from, to> of the next sync: two weeks of overlap from a UTC midnight, two years back at most, five minutes short of now."""
    floor_ = now - F.expr("interval 730 days")
    start = F.coalesce(F.date_trunc("day", last_to - F.expr("interval 14 days")), floor_)
    return F.struct(F.greatest(start, floor_).alias("from"), (now - F.expr("interval 5 minutes")).alias("to"))
