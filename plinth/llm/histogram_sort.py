"""Sharding by histogram sort, in built-in SQL: shards of near-equal bytes, split at exact key boundaries.

Rows are ordered by a 64-bit key (a hash of doc_id and text, so shards are mixed) and, among equal keys, by the row's
place in the written key table. Each round counts the exact bytes in the 2**RADIX_BITS cells of the prefixes that
still hold a splitter, over all partitions, and descends into the cell that the target falls in; it stops once the
bytes below a cell boundary are within the tolerance, or goes on into the places of one key's rows. The driver sees
at most (shards - 1) * 2**RADIX_BITS counts a round. Then rows are exchanged once, by shard and cell, and numbered in
the order of key and place. Cells are as fine as the number of rows asks for (CELL_ROWS in each).

Groups of equal texts, or of wholly equal rows, may be of any size: they are cut where the bytes say. A cell of more
than HOT_ROWS rows holds many equal ones, as the key is a hash; its rows are dealt out by key and source partition,
which is the same order. Null texts have no bytes and size 1, very long ones are only measured; a null doc_id is a value
like any other; an empty table gives an empty result; further columns are ignored (`write_shards` keeps them).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plinth.llm.shared import materialize, small_side, unused

RADIX_BITS = 12
#: Rows of a cell in the mean, and rows from which on a cell is dealt out by key and source partition.
CELL_ROWS, HOT_ROWS = 1024, 4096
#: Bytes that a splitter may be off, as a share of a shard, and in bytes at least.
TOLERANCE = 0.0005


def _prefix(value: Column, depth: int, bits: int) -> Column:
    """The leading depth * RADIX_BITS bits of a signed 64-bit value, ordered like the value."""
    return F.shiftright(value, max(0, bits - depth * RADIX_BITS))


def _descend(rows: DataFrame, column: str, targets: dict[int, int], slack: int, nearest: bool = False, bits: int = 64) -> dict[int, tuple[int, int, bool]]:
    """For each target of bytes: (value, bytes below it, done). Rows below the value are left of the splitter.

    Not done: the value's own rows hold the target; with `nearest`, they go to the side that is nearer to it.
    """
    active = {t: (0, None, 0) for t in targets}  # bytes below the prefix, the prefix, its own bytes
    found: dict[int, tuple[int, int, bool]] = {}
    depth = 0
    while active and depth * RADIX_BITS < bits:
        depth += 1
        cell = _prefix(F.col(column), depth, bits)
        part = rows
        if depth > 1:
            part = rows.filter(_prefix(F.col(column), depth - 1, bits).isin(*{p for _, p, _ in active.values()}))
        counted = part.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes")).collect()
        cells = sorted((r["cell"], r["bytes"]) for r in counted)
        shift, up = max(0, bits - depth * RADIX_BITS), max(0, bits - (depth - 1) * RADIX_BITS)
        for t, (below, prefix, _) in list(active.items()):
            for c, b in cells:
                if prefix is not None and c >> (up - shift) != prefix:
                    continue
                if abs(below - targets[t]) <= slack:
                    found[t] = (c << shift, below, True)
                elif below + b > targets[t] + slack:
                    active[t] = (below, c, b)
                else:
                    below += b
                    continue
                break
            else:
                last = next(c for c, _ in reversed(cells) if prefix is None or c >> (up - shift) == prefix)
                found[t] = ((last + 1) << shift, below, True)
            if t in found:
                del active[t]
    past = {t: nearest and 2 * (targets[t] - below) > b for t, (below, _, b) in active.items()}
    return found | {t: (p + past[t], below, False) for t, (below, p, _) in active.items()}


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(key, place) of the first row of shards 1, 2, …; rows has key, place and size."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    targets = {k: total * k // shards for k in range(1, shards)}
    slack = int(total / shards * tolerance)
    found = _descend(rows, "key", targets, slack)
    open_ = {k: v for k, v in found.items() if not v[2]}
    out = {k: (v[0], -1) for k, v in found.items() if v[2]}
    for key in {v[0] for v in open_.values()}:
        inner = {k: targets[k] - v[1] for k, v in open_.items() if v[0] == key}
        ties = rows.filter(F.col("key") == key)
        out |= {k: (key, v[0]) for k, v in _descend(ties, "place", inner, slack, nearest=True).items()}
    return [out[k] for k in sorted(out)]


def keyed(docs: DataFrame, whole: bool = False) -> DataFrame:
    """(size, text_crc32, key, place, and doc_id or, as a struct `doc`, the whole row), written once."""
    text = F.coalesce("text", F.lit(""))
    return materialize(
        docs.select(
            F.struct(*[docs[c] for c in docs.columns]).alias("doc") if whole else F.col("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), text).alias("key"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "shard-keys",
    )


def shard_rows(rows: DataFrame, shards: int = 8, tolerance: float = TOLERANCE) -> DataFrame:
    """Adds shard and slot (gapless from 0, in the order of key and place) to rows with key, place and size."""
    cuts = splitters(rows, shards, tolerance)
    bits = max(RADIX_BITS, math.ceil(math.log2(max(1, rows.count()) / CELL_ROWS)))
    shard = F.lit(0)
    for key, place in cuts:
        shard = shard + ((F.col("key") > key) | ((F.col("key") == key) & (F.col("place") >= place))).cast("int")
    celled = rows.withColumn("shard", shard).withColumn("cell", F.shiftright("key", 64 - bits))
    sizes = materialize(celled.groupBy("shard", "cell").agg(F.count("*").alias("n")), "shard-counts")
    hot = small_side(materialize(sizes.filter(F.col("n") > HOT_ROWS).select("shard", "cell", F.lit(True).alias("hot")), "shard-hot"))
    dealt = celled.join(hot, ["shard", "cell"], "left")
    dealt = dealt.withColumns({"own": F.when(F.col("hot"), F.col("key")).otherwise(0), "part": F.when(F.col("hot"), F.shiftright("place", 33)).otherwise(0)})
    group = ["shard", "cell", "own", "part"]
    inner = dealt.filter("hot").groupBy(*group).agg(F.count("*").alias("n"))
    plain = sizes.filter(F.col("n") <= HOT_ROWS).select("shard", "cell", F.lit(0).cast("long").alias("own"), F.lit(0).cast("long").alias("part"), "n")
    sizes = materialize(plain.unionByName(inner), "shard-groups").withColumn("coarse", F.shiftright("cell", bits - RADIX_BITS))
    # offsets in two steps, of coarse cells in a shard and of groups in a coarse cell, so no task numbers all groups
    below = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    coarse = sizes.groupBy("shard", "coarse").agg(F.sum("n").alias("n")).withColumn("base", below(W.partitionBy("shard").orderBy("coarse")))
    offsets = sizes.withColumn("inside", below(W.partitionBy("shard", "coarse").orderBy("cell", "own", "part")))
    offsets = offsets.join(F.broadcast(coarse.drop("n")), ["shard", "coarse"])  # 2**RADIX_BITS rows and one a shard at most
    offsets = materialize(offsets.select(*group, (F.col("base") + F.col("inside")).alias("offset")), "shard-offsets")
    placed = dealt.join(small_side(offsets), group)
    number = F.row_number().over(W.partitionBy(*group).orderBy("key", "place")) - 1
    return placed.withColumn("slot", (F.col("offset") + number).cast("long")).withColumn("shard", F.col("shard").cast("int"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Law `bytes`: the sizes of any two shards differ by no more than the tolerance and one row."""
    done = shard_rows(keyed(docs), shards)
    return done.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> str:
    """Write whole rows as Parquet, a folder for each shard, with their slot; they are exchanged once. Returns the name
    of the shard column (`shard`, or one that the table doesn't have yet); the slot column is named likewise."""
    shard, slot = unused(docs, "shard"), unused(docs, "slot")
    done = shard_rows(keyed(docs, whole=True), shards)
    done.select("doc.*", F.col("slot").alias(slot), F.col("shard").alias(shard)).write.partitionBy(shard).parquet(path)
    return shard
