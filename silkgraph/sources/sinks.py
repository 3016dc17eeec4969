"""Text sinks. Reports are one file, written by one task in the promised order; their sort is not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from silkgraph.sources.shared import shared_dir

#: Byte order mark at the head of a CSV for spreadsheets.
BOM = "﻿"
LEADERBOARD = ("division", "score", "team_name", "users", "submit_time")


def write_lines(lines: DataFrame, path: str) -> None:
    """The text column of ``lines``, in the order given, as the one file ``path``, which is replaced.

    Rows are range-sorted by many tasks; one task writes the sorted parts one
    after another, as a single file needs it.
    """
    spark = lines.sparkSession
    part = shared_dir(spark, "report")
    lines.coalesce(1).write.text(part)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    folder, target = fs_path(part), fs_path(path)
    found = [f.getPath() for f in folder.getFileSystem(conf).listStatus(folder) if f.getPath().getName().startswith("part-")]
    util = spark._jvm.org.apache.hadoop.fs.FileUtil
    store = target.getFileSystem(conf)
    store.delete(target, True)
    if found:
        util.copy(found[0].getFileSystem(conf), found[0], store, target, False, True, conf)
    else:
        store.create(target).close()
    folder.getFileSystem(conf).delete(folder, True)


def cycle_report(cycles: DataFrame) -> DataFrame:
    """``len, path, line``: the number of cycles (``len`` 0), then a line for each, shortest first, ids in numeric order."""
    total = cycles.agg(F.count("*").cast("string").alias("line")).select(F.lit(0).alias("len"), F.array().cast("array<bigint>").alias("path"), "line")
    lines = cycles.select("len", "path", F.concat_ws(",", F.col("path").cast("array<string>")).alias("line"))
    return total.unionByName(lines)


def write_cycle_report(cycles: DataFrame, path: str) -> None:
    write_lines(cycle_report(cycles).orderBy("len", "path").select("line"), path)


def format_ranking(rows: list) -> list[str]:
    """``id,score`` with three decimals of the exact binary value, for at most a hundred collected rows."""
    return [f"{r['id']},{r['bc']:.3f}" for r in rows]


def write_ranking(scores: DataFrame, path: str, n: int = 100) -> None:
    """At most ``n`` lines ``id,score``, best first, ties by id."""
    top = scores.select("id", "bc").orderBy(F.desc(F.round("bc", 3)), "id").limit(n).collect()
    lines = [(i, line) for i, line in enumerate(format_ranking(top))]
    write_lines(scores.sparkSession.createDataFrame(lines, "at int, line string").orderBy("at").select("line"), path)


def write_labels(predictions: DataFrame, path: str) -> None:
    """One label a line, in order of rows."""
    write_lines(predictions.orderBy("row_id").select(F.col("pred").cast("string").alias("value")), path)


def distance_line(distances: DataFrame, n: int, unreachable: int = 2147483647) -> DataFrame:
    """Distances of vertices 1 to ``n``, separated by blanks; a report of one line."""
    every = distances.sparkSession.range(1, n + 1).join(distances, F.col("id") == F.col("v"), "left")
    pairs = F.array_sort(F.collect_list(F.struct("id", F.coalesce("dist", F.lit(unreachable)).alias("d"))))
    return every.agg(F.array_join(F.transform(pairs, lambda p: p["d"].cast("string")), " ").alias("line"))


def write_distances(distances: DataFrame, n: int, path: str) -> None:
    write_lines(distance_line(distances, n), path)


def _csv(value: Column) -> Column:
    """A CSV field; quoted where it holds a quote, a comma or a line break."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_leaderboard(rows: DataFrame, path: str) -> None:
    """One CSV in UTF-8 with a byte order mark and a header, lists joined by blanks; by division, best score first, then team."""
    flat = rows.withColumn("users", F.array_join("users", " "))
    line = F.concat_ws(",", *[_csv(F.col(c)) for c in LEADERBOARD])
    body = flat.select(F.lit(1).alias("at"), "division", F.col("score").alias("by"), "team_name", line.alias("line"))
    head = rows.sparkSession.createDataFrame([(0, BOM + ",".join(LEADERBOARD))], "at int, line string")
    write_lines(head.unionByName(body, allowMissingColumns=True).orderBy("at", "division", F.desc("by"), "team_name", "line").select("line"), path)
