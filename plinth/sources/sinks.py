"""Tables, matrices, reports and logs to files. All are written by Spark, so any file system will do."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _put_text(spark: SparkSession, path: str, text: str, mode: str = "overwrite") -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)


def write_table(df: DataFrame, path: str, meta: dict | None = None, partition_by: list[str] = ()) -> None:
    """Parquet, with a JSON sidecar of its metadata (schema included) beside it."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    _put_text(df.sparkSession, f"{path.rstrip('/')}.meta", json.dumps({"schema": df.schema.simpleString(), **(meta or {})}))


def write_matrices(scored: DataFrame, path: str, names: list[str], scope: str = "global") -> dict:
    """One table of triples for each measure below path/measure/scope, and a manifest with their sizes."""
    sizes = {}
    for n in names:
        out = scored.filter(F.col(n).isNotNull() & (F.col(n) != 0)).select("i", "j", F.col(n).alias("v"))
        out.write.mode("overwrite").parquet(f"{path}/{n}/{scope}")
        sizes[n] = scored.sparkSession.read.parquet(f"{path}/{n}/{scope}").count()
    manifest = {"scope": scope, "pairs": sizes}
    _put_text(scored.sparkSession, f"{path}/manifest-{scope}", json.dumps(manifest))
    return manifest


def append_log(spark: SparkSession, path: str, source: str, run_at: str, items: int, unresolved: int, notes: str = "") -> None:
    rows = [(source, run_at, items, unresolved, notes)]
    spark.createDataFrame(rows, "source string, run_at string, items long, unresolved long, notes string").write.mode("append").parquet(path)


def append_lines(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_partitions(df: DataFrame, path: str, scope: list[str]) -> None:
    """Replaces only the partitions that the rows belong to."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*scope).parquet(path)


def markdown(title: str, sections: dict[str, DataFrame], rows: int = 50) -> str:
    """A report of small summary tables, `rows` lines of each (a report's own limit)."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in df.limit(rows).collect()]
    return "\n".join(out) + "\n"


def create_tables(spark: SparkSession, database: str, ddl: dict[str, str]) -> None:
    """Tables of given columns if absent; columns that an existing table lacks are added."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in ddl.items():
        full = f"{database}.{name}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {full} ({columns}) USING parquet")
        have = set(spark.table(full).columns)
        new = [c.strip() for c in columns.split(",") if c.split()[0] not in have]
        if new:
            spark.sql(f"ALTER TABLE {full} ADD COLUMNS ({', '.join(new)})")


def rename_table(spark: SparkSession, old: str, new: str) -> None:
    """Renames a table if the old name is there and the new one isn't."""
    if spark.catalog.tableExists(old) and not spark.catalog.tableExists(new):
        spark.sql(f"ALTER TABLE {old} RENAME TO {new}")
