"""Scratch tables in the folder that the cluster shares, and joins by a checked size."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.sources.scratch import materialize, scratch_path

__all__ = ["materialize", "scratch_path", "ship", "small_side", "table", "text_hash", "unused", "without_rows"]

#: Rows of a narrow table (ids, counts, thresholds: under 64 bytes a row) that may be broadcast.
BROADCAST_ROWS = 400_000
#: Bytes of an Arrow batch, and Spark's setting for it with its default; another value is left as it is.
BATCH_BYTES = 8 << 20
_BATCH, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864"


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only if the counted rows stay within the limit; beyond it the join shuffles."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("merge")


def text_hash(docs: DataFrame) -> Column:
    """With doc_id, what tells rows of `docs` apart; null texts count as empty."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def without_rows(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id and text_hash are none of `removed` (doc_id, h). A null doc_id is an id like any other."""
    keys = removed.select("doc_id", "h").distinct()
    keys = small_side(keys, keys.count())
    return docs.join(keys, docs["doc_id"].eqNullSafe(keys["doc_id"]) & (text_hash(docs) == keys["h"]), "left_anti")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make ready for Python workers: send them this package, once a session (nothing is installed there), and where
    Spark's own bound of an Arrow batch holds, lower it, as texts are held several times over while they are worked on."""
    if spark.conf.get(_BATCH).rstrip("b") == _DEFAULT:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_plinth_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="plinth-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._plinth_shipped = True
