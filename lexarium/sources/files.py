"""File sources: Markdown trees, mapping tables, word lists, click logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLICK = "q string, doc_id string, rank int, match string, mode string, snapshot_id string"


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob: ** crosses folders, * and ? don't."""
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        else:
            out, k = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[k], re.escape(glob[k])), k + 1
    return f"^{out}$"


def matching(files: DataFrame, name: str, size: str, include: list[str], exclude: list[str], least: int = 0, most: int = 10 << 20) -> DataFrame:
    """Files that an include pattern matches (any, if there is none) and no exclude pattern, of a size within bounds."""
    any_of = lambda globs: F.col(name).rlike("|".join(map(glob_pattern, globs)))
    keep = F.col(size).between(least, most)
    if include:
        keep = keep & any_of(include)
    if exclude:
        keep = keep & ~any_of(exclude)
    return files.where(keep)


def markdown_tree(spark: SparkSession, root: str) -> DataFrame:
    """doc_id (relative path), raw, size, source_hash of the .md files under root."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(root)
    # paths come with a scheme; what follows the root's own name is the id
    at = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return files.select(at.alias("doc_id"), F.col("content").cast("string").alias("raw"), F.col("length").alias("size"), F.sha2(F.col("content"), 256).alias("source_hash"))


def missing(files: DataFrame, required: list[str]) -> DataFrame:
    """Required ids that aren't among files."""
    return files.sparkSession.createDataFrame([(r,) for r in required], "doc_id string").join(files, "doc_id", "left_anti")


def mapping_table(spark: SparkSession, path: str) -> DataFrame:
    """uri, title of the rows of Markdown tables whose first cell is a .md address; the last row of an address counts."""
    lines = spark.read.format("text").option("wholetext", "true").load(path).select(F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    cells = lines.where(F.trim("line").startswith("|")).select("n", F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.regexp_replace(F.trim(c), "`", "")).alias("c"))
    rows = cells.where((F.size("c") >= 2) & F.col("c")[0].contains(".md")).select("n", F.col("c")[0].alias("uri"), F.col("c")[F.size("c") - 1].alias("title"))
    return rows.groupBy("uri").agg(F.max_by("title", "n").alias("title"))


def canonical_title(docs: DataFrame, mapped: DataFrame) -> DataFrame:
    """doc_id, title: from the table, else made of channel and number of a three-part address, else the address."""
    parts = F.split("doc_id", "/")
    number = F.regexp_extract(parts[2], r"^0*([0-9]+(?:\.5)?)\.md$", 1)
    made = F.when((F.size(parts) == 3) & (number != ""), F.concat(parts[0], F.lit(" "), number))
    return docs.join(mapped.withColumnRenamed("uri", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("title", made, "doc_id").alias("title"))


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """word, frequency of a word list; # begins a comment."""
    line = F.trim(F.regexp_replace("value", "#.*$", ""))
    return spark.read.text(path).select(F.split(line, r"\s+").alias("w")).where(F.col("w")[0] != "").select(F.col("w")[0].alias("word"), F.get("w", F.lit(1)).try_cast("long").alias("frequency"))


def click(line: Column) -> Column:
    """The click of a log line, or null: JSON after the marker."""
    return F.from_json(F.when(F.instr(line, "search_click ") > 0, F.substring_index(line, "search_click ", -1)), CLICK)


def click_log(spark: SparkSession, path: str) -> DataFrame:
    """Clicks of log files; lines without one, or with bad JSON, are left out."""
    return spark.read.text(path).select(click(F.col("value")).alias("c")).where("c.doc_id IS NOT NULL").select("c.*")
