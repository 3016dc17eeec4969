"""Nested ranking documents as a flat table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "result STRUCT<teamRankingList: STRUCT<results: ARRAY<STRUCT<score: DOUBLE, teamName: STRING, submitTime: STRING, userList: ARRAY<STRUCT<domainName: STRING>>>>>>"


def flatten(docs: DataFrame) -> DataFrame:
    """``division, score, team_name, users, submit_time`` from JSON bodies (``division, body``).

    A missing score is -1, other missing texts are "null"; a body that isn't
    JSON, or has no results, gives no rows.
    """
    parsed = docs.select("division", F.from_json("body", SCHEMA).alias("j"))
    teams = parsed.select("division", F.explode("j.result.teamRankingList.results").alias("t"))
    text = lambda c: F.coalesce(c, F.lit("null"))
    users = F.coalesce(F.transform("t.userList", lambda u: text(u["domainName"])), F.array().cast("array<string>"))
    return teams.select("division", F.coalesce("t.score", F.lit(-1.0)).alias("score"), text(F.col("t.teamName")).alias("team_name"), users.alias("users"), text(F.col("t.submitTime")).alias("submit_time"))


def read_leaderboard(spark: SparkSession, path: str) -> DataFrame:
    """Captured bodies, a document a line, with the file's name as division."""
    return flatten(spark.read.text(path).select(F.regexp_extract(F.input_file_name(), r"([^/]*)$", 1).alias("division"), F.col("value").alias("body")))


def sample_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ranking document for each conversation: turns are its score (left out where odd), roles its users."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    teams = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    team = F.struct(
        F.when(F.col("n") % 2 == 0, F.col("n").cast("double")).alias("score"),
        F.concat(F.lit("team-"), F.col("conv_id").cast("string")).alias("teamName"),
        F.transform("t", lambda x: F.struct(x["role"].alias("domainName"))).alias("userList"),
    )
    body = F.to_json(F.struct(F.struct(F.struct(F.array(team).alias("results")).alias("teamRankingList")).alias("result")))
    return teams.select((F.col("conv_id") % 4).alias("division"), body.alias("body"))
