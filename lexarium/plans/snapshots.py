"""Builds and snapshots: the base is what an earlier build saw of documents, derived by id; registries come from events."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators import builds, paging, snapshots, store
from lexarium.plans.base import query, stored_index, table
from lexarium.sources import shared

VERSION = 2
BASE = """cur AS (SELECT doc_id AS key, sha256(text || '|' || source) AS source_hash, sha256(text) AS body_hash FROM documents WHERE doc_id % 11 <> 5),
base AS (SELECT doc_id AS key, CASE WHEN doc_id % 7 IN (1, 2) THEN 'x' ELSE '' END || sha256(text || '|' || source) AS source_hash, CASE WHEN doc_id % 13 = 4 THEN NULL WHEN doc_id % 7 = 2 THEN 'x' ELSE sha256(text) END AS body_hash,
  CASE WHEN doc_id % 17 = 3 THEN 1 ELSE 2 END AS version FROM documents WHERE doc_id % 10 <> 6)"""
CHANGES = """changes AS (SELECT coalesce(b.key, c.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'deleted'
  WHEN b.source_hash = c.source_hash AND b.body_hash IS NOT NULL AND b.version = 2 THEN 'unchanged' WHEN b.body_hash IS NULL THEN 'legacy'
  WHEN b.version <> 2 OR b.body_hash <> c.body_hash THEN 'body_modified' ELSE 'source_only' END AS change FROM base b FULL JOIN cur c ON b.key = c.key)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents")
    k, h, b = F.col("doc_id"), F.sha2(F.concat("text", F.lit("|"), "source"), 256), F.sha2("text", 256)
    current = d.where(k % 11 != 5).select(k.alias("key"), h.alias("source_hash"), b.alias("body_hash"))
    base = d.where(k % 10 != 6).select(k.alias("key"), F.concat(F.when((k % 7).isin(1, 2), "x").otherwise(""), h).alias("source_hash"), F.when(k % 13 == 4, F.lit(None)).when(k % 7 == 2, "x").otherwise(b).alias("body_hash"), F.when(k % 17 == 3, 1).otherwise(2).alias("version"))
    return base, current


@query(f"WITH {BASE}, {CHANGES} SELECT key, change FROM changes")
def change_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of change between two builds."""
    return snapshots.change_set(*_sides(spark, sf_dir), VERSION)


@query(f"""WITH {BASE}, {CHANGES}, work AS (SELECT key, CASE WHEN change IN ('added', 'legacy', 'body_modified') THEN 'reindex' WHEN change = 'deleted' THEN 'remove' WHEN change = 'source_only' OR (key % 5 = 1 AND key % 10 <> 6) THEN 'render' END AS work FROM changes)
SELECT key, work FROM work WHERE work IS NOT NULL""")
def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a build does for each document: index, render anew (its source or title has changed), or remove."""
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.left("text", F.lit(20)).alias("title"))
    before = titles.where("key % 10 <> 6").withColumn("title", F.when(F.col("key") % 5 == 1, F.concat(F.lit("old "), "title")).otherwise(F.col("title")))
    return snapshots.plan_of(snapshots.change_set(*_sides(spark, sf_dir), VERSION), before, titles)


def hashed_words(texts: list[str], size: int = 16) -> list[list[float]]:
    """A vector without a model: words counted by their hash."""
    out = []
    for t in texts:
        v = [0.0] * size
        for w in t.split():
            v[zlib.crc32(w.encode()) % size] += 1.0
        out.append(v)
    return out


def _tree(docs: DataFrame, name: str, words: str, note: str) -> DataFrame:
    """Sources of documents: a title, a note, and a body without marks."""
    body = F.concat(F.regexp_replace("text", r"[#\[\]]", ""), F.expr(words))
    raw = F.concat(F.lit("# Title "), "doc_id", F.lit("\n"), F.expr(note), F.lit("\n## Body\n"), body)
    return docs.select(F.concat(F.lit(name), "doc_id", F.lit(".md")).alias("doc_id"), raw.alias("raw"), F.sha2(raw, 256).alias("source_hash"))


@query("""SELECT what, n FROM (SELECT count(*) FILTER (WHERE doc_id % 80 = 7 OR doc_id % 50 = 3) AS reindex, count(*) FILTER (WHERE doc_id % 60 = 11 AND doc_id % 80 <> 7 AND doc_id % 50 <> 3) AS render, count(*) FILTER (WHERE doc_id % 90 = 1) AS remove,
count(*) AS documents, count(*) FILTER (WHERE doc_id % 80 <> 7) + count(*) FILTER (WHERE doc_id % 90 = 1) + reindex + render + remove AS audit, 0::BIGINT AS "chunks without vector" FROM documents) UNPIVOT (n FOR what IN (reindex, render, remove, documents, audit, "chunks without vector"))""")
def build_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two builds: what the second one does to documents that are new, changed in text or source alone, or gone."""
    docs, root = table(spark, sf_dir, "documents"), shared.folder(spark, "builds")
    older = _tree(docs.where("doc_id % 80 <> 7"), "d/", "CASE WHEN doc_id % 50 = 3 THEN ' that were there before' ELSE '' END", "CASE WHEN doc_id % 60 = 11 THEN 'old note' ELSE '' END")
    gone = _tree(docs.where("doc_id % 90 = 1"), "d/gone", "''", "''")
    builds.run_once(spark, older.unionByName(gone), root, hashed_words)
    done = builds.run_once(spark, _tree(docs, "d/", "''", "''"), root, hashed_words)
    at = done.index
    lost = at.table("chunks").join(builds.vectors(at), "text_hash", "left_anti").count()
    rows = [*done.work.items(), ("documents", at.documents.count()), ("audit", builds.audit(at).count()), ("chunks without vector", lost)]
    return spark.createDataFrame(rows, "what string, n long")


@query(f"WITH {BASE}, {CHANGES} SELECT key, coalesce(CASE WHEN change = 'unchanged' THEN b.source_hash END, c.source_hash) AS source_hash, coalesce(CASE WHEN change = 'unchanged' THEN b.body_hash END, c.body_hash) AS body_hash, 2 AS version FROM changes LEFT JOIN base b USING (key) JOIN cur c USING (key)")
def index_state_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index state that the next build starts from."""
    base, current = _sides(spark, sf_dir)
    return snapshots.merged_state(base, current, snapshots.change_set(base, current, VERSION), VERSION)


@query(f"WITH {BASE}, {CHANGES} SELECT key, CASE change WHEN 'added' THEN 'ADD' WHEN 'deleted' THEN 'DELETE' WHEN 'source_only' THEN 'SOURCE_ONLY' ELSE 'MODIFY' END AS action FROM changes WHERE change <> 'unchanged'")
def audit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audit row for each change."""
    found = snapshots.change_set(*_sides(spark, sf_dir), VERSION).where("change <> 'unchanged'")
    action = F.when(F.col("change") == "added", "ADD").when(F.col("change") == "deleted", "DELETE").when(F.col("change") == "source_only", "SOURCE_ONLY").otherwise("MODIFY")
    return found.select("key", action.alias("action"))


@query("SELECT unnest(['documents', 'coverage', 'lexicon', 'lengths', 'statistics', 'positions', 'texts']) AS \"check\", 0::BIGINT AS wrong")
def self_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the stored index that break its rules: none."""
    return store.checks(stored_index(spark, sf_dir), table(spark, sf_dir, "documents"))


REG = """reg AS (SELECT 's' || event_id AS snapshot_id, CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS lineage, 'm@64' AS embedding_space, (3 + user_id % 3)::INT AS format_version,
CASE WHEN event_id % 5 = 1 THEN 'retired' ELSE 'published' END AS status, event_id % 97 = 3 AS pinned, ts AS published_at, CASE WHEN event_id % 5 = 1 THEN ts + INTERVAL 1 HOUR END AS retired_at FROM events)"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    m = F.col("user_id") % 3
    gone = F.col("event_id") % 5 == 1
    return e.select(F.concat(F.lit("s"), "event_id").alias("snapshot_id"), F.when(m == 0, "a").when(m == 1, "b").otherwise("c").alias("lineage"), F.lit("m@64").alias("embedding_space"), (3 + m).cast("int").alias("format_version"), F.when(gone, "retired").otherwise("published").alias("status"), (F.col("event_id") % 97 == 3).alias("pinned"), F.col("ts").alias("published_at"), F.when(gone, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("retired_at"))


NOW = "2024-02-01 00:00:00"


@query(f"""WITH {REG}, live AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY published_at DESC, snapshot_id DESC) AS n, min(published_at) OVER (PARTITION BY lineage ORDER BY floor(epoch(published_at))::BIGINT RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS superseded_at FROM reg WHERE status = 'published' AND NOT pinned),
aged AS (SELECT *, (epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(superseded_at))::BIGINT) / 60.0 AS s_age, (epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(published_at))::BIGINT) / 60.0 AS p_age FROM live)
SELECT snapshot_id, lineage, CASE WHEN lineage = 'a' THEN 'superseded' ELSE 'foreign' END AS reason FROM aged WHERE (lineage = 'a' AND n > 2 AND s_age >= 10) OR (lineage <> 'a' AND ((n > 1 AND s_age >= 10) OR (n = 1 AND p_age >= 10080)))
UNION ALL SELECT snapshot_id, lineage, 'retired' FROM reg WHERE status = 'retired' AND NOT pinned AND (epoch(TIMESTAMP '{NOW}')::BIGINT - floor(epoch(retired_at))::BIGINT) / 60.0 >= 1440""")
def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that retention lets go."""
    return snapshots.disposable(_registry(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), "a")


@query(f"WITH {REG} SELECT snapshot_id, lineage, format_version FROM reg WHERE status = 'published' AND format_version IN (4, 5) ORDER BY pinned DESC, format_version DESC, published_at DESC, snapshot_id DESC LIMIT 1")
def registry_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The snapshot that readers take."""
    return snapshots.pick(_registry(spark, sf_dir), "m@64", [4, 5]).select("snapshot_id", "lineage", "format_version")


RUNS = "SELECT user_id AS job, ts AS started_at, CASE WHEN value < 30 THEN 'failed' WHEN value < 40 THEN 'skipped' WHEN value < 45 THEN 'no_change' ELSE 'success' END AS outcome FROM events"


@query(f"WITH runs AS ({RUNS}), reset AS (SELECT job, max(started_at) AS reset_at FROM runs WHERE outcome IN ('success', 'no_change') GROUP BY job) SELECT runs.job, count(*) FILTER (WHERE outcome = 'failed' AND (reset_at IS NULL OR started_at > reset_at)) AS failures FROM runs LEFT JOIN reset USING (job) GROUP BY runs.job")
def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each job's failures in a row."""
    outcome = F.when(F.col("value") < 30, "failed").when(F.col("value") < 40, "skipped").when(F.col("value") < 45, "no_change").otherwise("success")
    return snapshots.failures_in_a_row(table(spark, sf_dir, "events").select(F.col("user_id").alias("job"), F.col("ts").alias("started_at"), outcome.alias("outcome")))


@query("SELECT event_id, ts, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50")
def audit_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 audit rows."""
    return table(spark, sf_dir, "events").orderBy(F.col("ts").desc_nulls_last(), F.col("event_id").desc()).limit(50).select("event_id", "ts", "event_type")


DATED = "dated AS (SELECT doc_id, lang, source, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE (DATE '2020-01-01' + (doc_id % 1500)::INT)::VARCHAR END AS published FROM documents)"


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.when(F.col("doc_id") % 9 != 0, day).alias("published"))


@query(f"WITH {DATED} SELECT doc_id, source, published FROM dated ORDER BY published DESC NULLS LAST, doc_id DESC LIMIT 50")
def latest_desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 documents."""
    return _dated(spark, sf_dir).orderBy(F.col("published").desc_nulls_last(), F.col("doc_id").desc()).limit(50).select("doc_id", "source", "published")


@query(f"WITH {DATED} SELECT doc_id, source, published, row_number() OVER (PARTITION BY source ORDER BY published DESC NULLS LAST, doc_id DESC) AS place FROM dated")
def transcript_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: each document's place in its channel, newest first, undated last."""
    rows = _dated(spark, sf_dir).withColumn("month", F.coalesce(F.left("published", F.lit(7)), F.lit("")))
    return paging.numbered_within(rows, ["source"], "month", [F.col("published").desc_nulls_last(), F.col("doc_id").desc()], "place").select("doc_id", "source", "published", "place")


@query(f"WITH {DATED} SELECT source, count(*) AS n, max(published) AS lastmod FROM dated GROUP BY source")
def channel_lastmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and newest date of each channel."""
    return _dated(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.max("published").alias("lastmod"))


@query("SELECT event_type, max(ts)::DATE::VARCHAR AS lastmod FROM events GROUP BY event_type UNION ALL SELECT '*', max(ts)::DATE::VARCHAR FROM events")
def sitemap_lastmod(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest change of each section and of all."""
    by = table(spark, sf_dir, "events").groupBy("event_type").agg(F.max("ts").alias("ts"))
    both = by.unionByName(by.agg(F.max("ts").alias("ts")).select(F.lit("*").alias("event_type"), "ts"))
    return both.select("event_type", F.to_date("ts").cast("string").alias("lastmod"))
