"""Conversations and click logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexarium.operators import answers, citations, clicks
from lexarium.plans.base import query, table


def _c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


GROUNDED = "(conv_id + turn) % 5 <> 2"


@query(f"SELECT conv_id, string_agg(role || ': ' || CASE WHEN role = 'assistant' THEN left(CASE WHEN {GROUNDED} THEN text ELSE '(no grounded answer)' END, 300) ELSE text END, chr(10) ORDER BY turn, role, text) AS history FROM conversations GROUP BY conv_id")
def history_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as one text, answers cut at 300 characters, those without grounds as a phrase."""
    return answers.histories(_c(spark, sf_dir).withColumn("grounded", F.expr(GROUNDED)))


PIECES = r"list_filter(list_transform(string_split(tail, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\s*([-*]|[0-9]+[.)])\s*', ''), '^\s+|\s+$', '', 'g')), lambda x: length(x) BETWEEN 4 AND 60)"


@query(f"SELECT conv_id, turn, role, trim(split_part(asked, '---', 1), ' ' || chr(10)) AS body, array_to_string(list_slice({PIECES}, 1, 3), '|') AS followups FROM (SELECT *, substr(asked, length(split_part(asked, '---', 1)) + 4) AS tail FROM (SELECT conv_id, turn, role, regexp_replace(text, '[.?!]', chr(10) || CASE WHEN turn % 2 = 0 THEN '---' ELSE '-' END, 'g') AS asked FROM conversations))")
def followup_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers (their sentences as lines) parted from up to three follow-ups of 4 to 60 characters, list marks off."""
    asked = F.regexp_replace("text", "[.?!]", F.when(F.col("turn") % 2 == 0, "\n---").otherwise("\n-"))
    found = _c(spark, sf_dir).select("conv_id", "turn", "role", answers.followups_column(asked).alias("f"))
    return found.select("conv_id", "turn", "role", "f.body", F.array_join("f.followups", "|").alias("followups"))


REPLY = "CASE conv_id % 4 WHEN 0 THEN 'None of these' WHEN 1 THEN 'All!' ELSE 'documents ' || (turn + 1) || ', ' || (conv_id % 40) || ' and 3' END"


@query(f"SELECT conv_id, turn, role, CASE WHEN conv_id % 4 = 0 THEN '' WHEN conv_id % 4 = 1 THEN array_to_string(range(13), ',') ELSE array_to_string(list_sort(list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({REPLY}, '[0-9]+'), lambda x: x::INT), lambda x: x BETWEEN 1 AND 13), lambda x: x - 1))), ',') END AS kept FROM conversations")
def grade_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grader's reply on 13 documents: none, all, or the places it names."""
    reply = F.expr(REPLY)
    return _c(spark, sf_dir).select("conv_id", "turn", "role", F.array_join(answers.graded_column(reply, F.lit(13)).cast("array<string>"), ",").alias("kept"))


@query("SELECT conv_id, turn, role, CASE WHEN length(trim(made)) = 0 OR length(made) > 2 * length(asked) + 120 THEN asked ELSE made END AS question FROM (SELECT conv_id, turn, role, left(text, 60) AS asked, CASE WHEN turn % 7 = 6 THEN ' ' ELSE text END AS made FROM conversations)")
def condense_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The question that is asked: the condensed one, unless it is empty or far longer than what was asked."""
    made = F.when(F.col("turn") % 7 == 6, " ").otherwise(F.col("text"))
    return _c(spark, sf_dir).select("conv_id", "turn", "role", answers.condensed_column(F.left("text", F.lit(60)), made).alias("question"))


@query()
def citation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with citations put in by turn, then repaired, deduplicated and placed."""
    made = F.concat("text", F.lit(" [doc: "), "turn", F.lit("] `["), "turn", F.lit("]` [99]"))
    return citations.tidied(_c(spark, sf_dir).select(F.concat_ws("-", "conv_id", "turn", "role").alias("id"), made.alias("answer"), F.array(F.col("turn").cast("int")).alias("known")))


RANK = "SELECT event_type AS q, (1 + floor(value))::BIGINT AS rank, user_id FROM events"


@query(f"SELECT q, count(*) AS clicks, round(avg(rank), 6) AS mean_rank, median(rank) AS median_rank, count(*) FILTER (WHERE rank = 1) AS first, count(*) FILTER (WHERE rank BETWEEN 2 AND 3) AS upper, count(*) FILTER (WHERE rank BETWEEN 4 AND 10) AS page, count(*) FILTER (WHERE rank > 10) AS later FROM ({RANK}) GROUP BY q")
def click_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicked ranks by query: mean, median, buckets."""
    return clicks.statistics(table(spark, sf_dir, "events").select(F.col("event_type").alias("q"), (1 + F.floor("value")).alias("rank")))


@query(f"SELECT q, user_id, round(avg(rank), 6) AS mean_rank, count(*) AS clicks FROM ({RANK}) GROUP BY q, user_id ORDER BY round(avg(rank), 6) DESC, count(*) DESC, q, user_id LIMIT 20")
def worst_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 queries (here of a user) that are clicked furthest down."""
    ranks = table(spark, sf_dir, "events").select(F.col("event_type").alias("q"), "user_id", (1 + F.floor("value")).alias("rank"))
    by = ranks.groupBy("q", "user_id").agg(F.round(F.avg("rank"), 6).alias("mean_rank"), F.count("*").alias("clicks"))
    return by.orderBy(F.col("mean_rank").desc(), F.col("clicks").desc(), "q", "user_id").limit(20)
