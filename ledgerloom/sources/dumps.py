"""Occupations from dumps of INSERT statements, and their composite texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.upsert import keep_first

# A quoted literal whose quotes are doubled, and the columns of three tables before the one that is last of interest.
_LITERAL = "'([^']*+(?:''[^']*+)*+)'"
_SHAPES = {
    "occupation_data": f"'([^']+)',\\s*{_LITERAL},\\s*{_LITERAL}",
    "task_statements": f"'([^']+)',\\s*[\\d.]+,\\s*{_LITERAL},\\s*'([^']*)'",
    "alternate_titles": f"'([^']+)',\\s*{_LITERAL}",
}
_COLUMNS = {"occupation_data": ("code", "title", "description"), "task_statements": ("code", "task", "task_type"), "alternate_titles": ("code", "title")}


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(seq, statement) of dumps, split at the ends of statements, so that large files are read by many tasks; seq is the order in a file."""
    lines = spark.read.option("lineSep", ");\n").text(path)
    return lines.select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth")).alias("seq"), F.col("value").alias("statement"))


def inserted(rows: DataFrame, table: str) -> DataFrame:
    """The columns of a table's INSERT statements (seq, statement), trimmed, with doubled quotes made single."""
    pattern = f"(?s)INSERT INTO {table}.*?VALUES \\({_SHAPES[table]}"

    def field(i: int) -> Column:
        return F.replace(F.trim(F.regexp_extract("statement", pattern, i)), F.lit("''"), F.lit("'"))

    return rows.where(F.col("statement").rlike(pattern)).select("seq", *(field(i).alias(c) for i, c in enumerate(_COLUMNS[table], 1)))


def composite_texts(occupations: DataFrame, tasks: DataFrame, titles: DataFrame, most_tasks: int = 10, most_titles: int = 20) -> DataFrame:
    """(code, text): title, other names, description and core tasks, in file order; of a repeated code the last row counts.

    Tasks and names are cut to their first few before they are gathered, so no list grows with the input.
    """
    known = occupations.groupBy("code").agg(F.max_by(F.struct("title", "description"), "seq").alias("o")).select("code", "o.*")
    core = keep_first(tasks.where("task_type = 'Core'"), ["code"], [F.col("seq")], most_tasks)
    names = keep_first(titles.groupBy("code", "title").agg(F.min("seq").alias("seq")), ["code"], [F.col("seq")], most_titles)

    def listed(df: DataFrame, column: str, into: str) -> DataFrame:
        return df.groupBy("code").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", column))), lambda x: x[column]).alias(into))

    both = known.join(listed(names, "title", "names"), "code", "left").join(listed(core, "task", "tasks"), "code", "left")
    text = F.concat_ws(
        "\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Also known as: "), F.array_join("names", ", ")), F.concat(F.lit("Description: "), "description"), F.concat(F.lit("Key Tasks: "), F.array_join("tasks", " ")))
    return both.select("code", text.alias("text"))
