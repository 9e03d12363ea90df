"""Snapshots: change sets, merged index state, registry selection, retention, and publishing to a folder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexarium.operators.paging import numbered_within
from lexarium.sources import shared

#: Format version, and retention: snapshots kept in a lineage, grace of superseded ones, of a foreign lineage's newest, of retired ones.
FORMAT_VERSION, KEEP, GRACE_MINUTES, FOREIGN_DAYS, RETIRED_HOURS = 5, 2, 10, 7, 24


def change_set(base: DataFrame, current: DataFrame, version: int) -> DataFrame:
    """key, change: base (key, source_hash, body_hash, version), current (key, source_hash, body_hash)."""
    b = base.select("key", F.col("source_hash").alias("b_source"), F.col("body_hash").alias("b_body"), F.col("version").alias("b_version"), F.lit(True).alias("in_base"))
    c = current.select("key", "source_hash", "body_hash", F.lit(True).alias("in_current"))
    legacy = F.col("b_body").isNull() | F.col("b_version").isNull()
    change = (
        F.when(F.col("in_base").isNull(), "added").when(F.col("in_current").isNull(), "deleted").when((F.col("b_source") == F.col("source_hash")) & ~legacy & (F.col("b_version") == version), "unchanged")
        .when(legacy, "legacy").when((F.col("b_version") != version) | (F.col("b_body") != F.col("body_hash")), "body_modified").otherwise("source_only")
    )
    return b.join(c, "key", "full").select("key", change.alias("change"))


def merged_state(base: DataFrame, current: DataFrame, changes: DataFrame, version: int) -> DataFrame:
    """The index state after a build: unchanged rows of base, others from current; deleted keys go. Nothing is updated in place."""
    old = base.join(changes.where("change = 'unchanged'").select("key"), "key", "left_semi").select("key", "source_hash", "body_hash", F.col("version").cast("int").alias("version"))
    new = current.join(changes.where("change NOT IN ('unchanged', 'deleted')").select("key"), "key", "left_semi").select("key", "source_hash", "body_hash", F.lit(version).alias("version"))
    return old.unionByName(new)


def pick(registry: DataFrame, space: str, formats: list[int]) -> DataFrame:
    """The published snapshot that readers use: highest format, then newest, then by id; a pinned one comes first."""
    usable = registry.where((F.col("status") == "published") & (F.col("embedding_space") == space) & F.col("format_version").isin(formats))
    return usable.orderBy(F.col("pinned").desc(), F.col("format_version").desc(), F.col("published_at").desc(), F.col("snapshot_id").desc()).limit(1)


def superseded(rows: DataFrame) -> DataFrame:
    """lineage, second, superseded_at: the earliest publishing in a later second of the lineage.

    Seconds meet by day: within a day by a window over it, across days by a row for each day, so no task gets a lineage whole."""
    second = F.unix_seconds(F.col("published_at").cast("timestamp"))
    seconds = rows.groupBy("lineage", second.alias("second")).agg(F.min("published_at").alias("first_at")).withColumn("day", F.floor(F.col("second") / 86400))
    days = seconds.groupBy("lineage", "day").agg(F.min("first_at").alias("day_first")).withColumn("next_day", F.lead("day_first").over(W.partitionBy("lineage").orderBy("day"))).drop("day_first")
    inside = F.lead("first_at").over(W.partitionBy("lineage", "day").orderBy("second"))
    return seconds.withColumn("inside", inside).join(days, ["lineage", "day"]).select("lineage", "second", F.coalesce("inside", "next_day").alias("superseded_at"))


def disposable(registry: DataFrame, now: Column, lineage: str) -> DataFrame:
    """Snapshots that may be dropped, with the reason: snapshot_id, lineage, reason."""
    second = F.unix_seconds(F.col("published_at").cast("timestamp"))
    live = registry.where("status = 'published' AND NOT pinned").withColumn("second", second).withColumn("day", F.floor(F.col("second") / 86400))
    live = numbered_within(live, ["lineage"], "day", [F.col("published_at").desc(), F.col("snapshot_id").desc()], "n").join(superseded(live), ["lineage", "second"], "left")
    age = lambda c: (F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col(c).cast("timestamp"))) / 60.0
    mine = (F.col("lineage") == lineage) & (F.col("n") > KEEP) & (age("superseded_at") >= GRACE_MINUTES)
    foreign = (F.col("lineage") != lineage) & (((F.col("n") > 1) & (age("superseded_at") >= GRACE_MINUTES)) | ((F.col("n") == 1) & (age("published_at") >= FOREIGN_DAYS * 1440)))
    gone = live.where(mine | foreign).select("snapshot_id", "lineage", F.when(mine, "superseded").otherwise("foreign").alias("reason"))
    retired = registry.where("status = 'retired' AND NOT pinned").where(age("retired_at") >= RETIRED_HOURS * 60).select("snapshot_id", "lineage", F.lit("retired").alias("reason"))
    return gone.unionByName(retired)


def fingerprint(*versions: object) -> str:
    """16 hex digits of what a build depends on."""
    return hashlib.sha256("|".join(map(str, versions)).encode()).hexdigest()[:16]


def snapshot_id(now: datetime, commit: str, taken: set[str]) -> str:
    """s, the UTC time and seven digits of the commit; a second later while that is taken."""
    while (name := f"s{now:%Y%m%d%H%M%S}_{commit[:7]}") in taken:
        now += timedelta(seconds=1)
    return name


def plan_of(changes: DataFrame, base_titles: DataFrame | None, titles: DataFrame) -> DataFrame:
    """key, work: what a build does for a document: reindex (body is new), render (only its source or title changed), remove.

    changes: key, change; titles, base_titles: key, title. Without a base all are reindexed."""
    if base_titles is None:
        return changes.where("change <> 'deleted'").select("key", F.lit("reindex").alias("work"))
    renamed = titles.join(base_titles.select("key", F.col("title").alias("old")), "key").where(~F.col("title").eqNullSafe(F.col("old"))).select("key", F.lit(True).alias("renamed"))
    work = F.when(F.col("change").isin("added", "legacy", "body_modified"), "reindex").when(F.col("change") == "deleted", "remove").when((F.col("change") == "source_only") | F.col("renamed"), "render")
    return changes.join(renamed, "key", "left").select("key", work.alias("work")).where("work IS NOT NULL")


def has_changes(changes: DataFrame) -> bool:
    return not changes.where("change <> 'unchanged'").isEmpty()


def with_source_hashes(state: DataFrame, edited: DataFrame) -> DataFrame:
    """state with the source hashes of edited (key, source_hash). Each edited key must be one row of state, or it fails."""
    bad = edited.groupBy("key").agg(F.count("*").alias("asked")).join(state.groupBy("key").agg(F.count("*").alias("had")), "key", "left").where("asked <> 1 OR coalesce(had, 0) <> 1")
    if rows := bad.select("key").limit(5).collect():
        raise ValueError(f"not one row each: {[r.key for r in rows]}")
    return state.join(edited.select("key", F.col("source_hash").alias("edited")), "key", "left").withColumn("source_hash", F.coalesce("edited", "source_hash")).drop("edited")


def with_titles_refreshed(documents: DataFrame, titles: DataFrame) -> DataFrame:
    """documents with title from titles (doc_id, title) where it differs; changed says where."""
    new = titles.select("doc_id", F.col("title").alias("new_title"), F.lit(True).alias("listed"))
    out = documents.join(new, "doc_id", "left")
    differs = F.coalesce("listed", F.lit(False)) & ~F.col("title").eqNullSafe(F.col("new_title"))
    return out.select(*[c for c in documents.columns if c != "title"], F.when(differs, F.col("new_title")).otherwise(F.col("title")).alias("title"), differs.alias("changed"))


def pick_for_search(registry: DataFrame, space: str, formats: list[int], search_version: int, prefer: str | None = None) -> DataFrame:
    """As pick(), among snapshots whose stats (JSON) have this search version; the chat's own one first, if it is among them."""
    usable = registry.where(F.get_json_object("stats", "$.search_version").cast("int") == search_version).where((F.col("status") == "published") & (F.col("embedding_space") == space) & F.col("format_version").isin(formats))
    first = (F.col("snapshot_id") == F.lit(prefer)) if prefer is not None else F.lit(False)
    return usable.orderBy(first.desc(), F.col("pinned").desc(), F.col("format_version").desc(), F.col("published_at").desc(), F.col("snapshot_id").desc()).limit(1)


def still_base(registry: DataFrame, base: str, lineage: str) -> bool:
    """Whether a build may still publish on this base: it is published, and the newest of its lineage."""
    newest = registry.where((F.col("status") == "published") & (F.col("lineage") == lineage)).orderBy(F.col("published_at").desc(), F.col("snapshot_id").desc()).limit(1).select("snapshot_id").collect()
    return bool(newest) and newest[0].snapshot_id == base


def previous_lineage(registry: DataFrame, space: str, lineage: str) -> DataFrame:
    """Published snapshots of the space's other lineages, which may be retired once the new lineage has one of its own. It fails
    if that has none, or if one of them is pinned."""
    live = registry.where((F.col("status") == "published") & (F.col("embedding_space") == space))
    counts = live.agg(F.count_if(F.col("lineage") == lineage).alias("own"), F.count_if((F.col("lineage") != lineage) & F.col("pinned")).alias("pinned")).first()
    if not counts.own or counts.pinned:
        raise ValueError("no current snapshot of the lineage" if not counts.own else "a snapshot of another lineage is pinned")
    return live.where(F.col("lineage") != lineage)


def with_status(registry: DataFrame, ids: list[str], action: str, now: Column) -> DataFrame:
    """The registry after retire, unretire, pin or unpin of a few snapshots; a new table, nothing is updated in place."""
    of = F.col("snapshot_id").isin(ids)
    status, retired_at, pinned = F.col("status"), F.col("retired_at"), F.col("pinned")
    if action == "retire":
        hit = of & (status == "published") & ~pinned
        status, retired_at = F.when(hit, "retired").otherwise(status), F.when(hit, now).otherwise(retired_at)
    elif action == "unretire":
        hit = of & (status == "retired")
        status, retired_at = F.when(hit, "published").otherwise(status), F.when(hit, F.lit(None)).otherwise(retired_at)
    elif action in ("pin", "unpin"):
        pinned = F.when(of, action == "pin").otherwise(pinned)
    else:
        raise ValueError(action)
    return registry.withColumns({"status": status, "retired_at": retired_at, "pinned": pinned})


def failures_in_a_row(runs: DataFrame) -> DataFrame:
    """job, failures: failed runs since the last success or no_change; skipped runs count as nothing. runs: job, started_at, outcome."""
    reset = runs.where("outcome IN ('success', 'no_change')").groupBy("job").agg(F.max("started_at").alias("reset_at"))
    later = F.col("reset_at").isNull() | (F.col("started_at") > F.col("reset_at"))
    return runs.join(reset, "job", "left").groupBy("job").agg(F.count_if((F.col("outcome") == "failed") & later).alias("failures"))


def publish(tables: dict[str, DataFrame], root: str, snapshot_id: str, check: Callable[[str], list[str]] | None = None) -> str:
    """Writes the tables to a hidden folder, checks them there, and renames it: readers see all of a snapshot or nothing.

    check gets the hidden folder and returns what is wrong; then, or if anything fails, the folder is deleted."""
    spark = next(iter(tables.values())).sparkSession
    hidden, final = f"{root}/_building-{snapshot_id}", f"{root}/{snapshot_id}"
    fs, path = shared.file_system(spark, root)
    if fs.exists(path(final)):
        raise FileExistsError(final)
    try:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{hidden}/{name}")
        if check is not None and (wrong := check(hidden)):
            raise ValueError(f"the snapshot is wrong: {', '.join(wrong)}")
        if not fs.rename(path(hidden), path(final)):
            raise OSError(f"can't rename {hidden}")
    except BaseException:
        fs.delete(path(hidden), True)
        raise
    return final


def drop(spark: SparkSession, root: str, ids: list[str]) -> list[str]:
    """Deletes snapshots' folders; those that were there."""
    fs, path = shared.file_system(spark, root)
    return [i for i in ids if fs.exists(path(f"{root}/{i}")) and fs.delete(path(f"{root}/{i}"), True)]


def open_snapshot(spark: SparkSession, at: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{at}/{name}")
