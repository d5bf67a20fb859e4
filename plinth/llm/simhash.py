"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees over shards.

Fingerprints differing in at most `radius` bits are linked; components of these links are the classes.

1. Fingerprints are made per text, then reduced to distinct values with their smallest doc_id.
2. Shards: 64 bits are cut into radius + r blocks. Two fingerprints within the radius agree on at least r blocks, so
   each goes once to every choice of r blocks, keyed by the bits there. r follows from the number of fingerprints, so
   that a shard holds about SHARD_ROWS of them at any size. A shard of more than SHARD_CAP is cut into parts; each pair
   of parts is one task's work, so no task holds a whole hot shard and no link is lost.
3. Within a shard (or pair of parts) a BK-tree is built: children keyed by integer Hamming distance to their parent.
   A search follows only the edges in [d - radius, d + radius], and no subtree that is all in the searcher's class
   already, so a crowd of near copies costs little. Links found are joined locally, and only those that join two trees
   of that local forest go out: fewer rows than fingerprints, never all pairs of a group. Shards are shuffled, not
   broadcast, as they grow with the corpus.
4. Components over these rows: min-label star contraction in DataFrames, each round written to the shared folder.

`keep_first` drops copies by wide fingerprints (WIDE bits) of distinct five-word shingles. Sets of similarity (Jaccard) J
have the cosine 2J / (1 + J) if they are of one size, and each bit differs with probability arccos(cosine) / pi; so the
number of differing bits tells J to within about 0.05, and WIDE_RADIUS takes all but a few pairs of J = 0.8. Blocks
would not select at such a radius: instead fingerprints meet by TABLES of sampled bits, as many as find MEET of the
pairs of J = 0.8 at the shard size that the number of fingerprints gives. Shards are searched as above.

* A null text, and one without words, has fingerprint zero, linked like any other.
* Repeated rows repeat in the result. A null doc_id keeps its fingerprint; a class of null ids only has a null component.
* An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import materialize, ship, small_side, text_hash, unused, without_rows

RADIUS = 4
SHINGLE = 4
SHARD_ROWS = 64
SHARD_CAP = 2048
#: Shingles whose bits are counted at once; longer texts go on in further steps.
STEP = 16_320
MASK = (1 << 64) - 1
#: Wide fingerprints: shingles of so many words, bits, and bits that may differ.
WIDE_SHINGLE, WIDE, WIDE_RADIUS = 5, 256, 46
_SEEDS = np.array([seed * 0x9E3779B97F4A7C15 & MASK for seed in range(1, WIDE // 64 + 1)], np.uint64)
#: Similarity whose pairs meet in a table with the probability MEET, and fingerprints in a shard of a table.
SIMILAR, MEET, WIDE_SHARD = 0.8, 0.97, 16


def _hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of the shingles of a text, STEP at a time; without words there are none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([digest(joined, 42)], "<u8")
        return
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[: len(words) - shingle])]
    for k in range(0, len(starts), STEP):
        part = zip(starts[k : k + STEP], ends[shingle - 1 + k :], strict=False)
        yield np.array([digest(joined[a:b], 42) for a, b in part], "<u8")


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the rows of hashes (n, words) have each bit set."""
    n, width = hashes.shape
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8 * width), axis=1, bitorder="little")
    # sums of up to 255 rows fit a byte
    whole = n // 255 * 255
    ones = bits[whole:].sum(axis=0, dtype=np.uint8).astype(np.int64)
    return ones + bits[:whole].reshape(-1, 255, 64 * width).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is set if it is set in over half of the shingles' hashes."""
    ones, count = np.zeros(64, np.int64), 0
    for part in _hashes(text, shingle):
        ones += _ones(part[:, None])
        count += len(part)
    bits = np.packbits(ones * 2 > count, bitorder="little")
    return int(bits.view("<i8")[0])


def wide_fingerprint(text: str | None, shingle: int = WIDE_SHINGLE) -> bytes:
    """SimHash of WIDE bits over the distinct shingles: each 64 of them by another mix of the shingles' hashes."""
    parts = list(_hashes(text, shingle))
    distinct = np.unique(np.concatenate(parts)) if parts else np.zeros(0, "<u8")
    ones = np.zeros(WIDE, np.int64)
    for k in range(0, len(distinct), STEP):
        x = distinct[k : k + STEP, None] + _SEEDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        ones += _ones(np.ascontiguousarray(x ^ (x >> np.uint64(31)), "<u8"))
    return np.packbits(ones * 2 > len(distinct), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, wide: bool = False) -> DataFrame:
    """(doc_id, h, fp) for every row; h is a hash of the text, fp 64 bits as a long or WIDE bits as bytes."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, kind = (wide_fingerprint, pa.binary()) if wide else (fingerprint, pa.int64())
        for b in batches:
            fps = pa.array([made(t.as_py(), shingle) for t in b.column(2)], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fps], ["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(docs).alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id long, h long, fp {'binary' if wide else 'long'}")


class BKTree:
    """A BK-tree over distinct unsigned integers; each node's children are keyed by their Hamming distance to it.

    Values within the radius are of one class, directly or in steps. `one[k]` tells that all below node k were of one
    class when they were added, so a search may pass it over once it has met that class.
    """

    def __init__(self, radius: int) -> None:
        self.radius = radius
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.one: list[bool] = []
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.one.append(True)
        if new:
            mine, at = self.root(value), 0
            while True:
                if self.one[at] and self.root(self.values[at]) != mine:
                    self.one[at] = False
                d = (value ^ self.values[at]).bit_count()
                nxt = self.children[at].get(d)
                if nxt is None:
                    self.children[at][d] = new
                    return
                at = nxt

    def join(self, value: int) -> Iterator[tuple[int, int]]:
        """Joins a value to the classes within the radius; yields the link that joined each."""
        radius, values = self.radius, self.values
        mine = self.root(value)
        stack = [0] if values else []
        while stack:
            at = stack.pop()
            if self.one[at] and self.root(values[at]) == mine:
                continue
            d = (value ^ values[at]).bit_count()
            if d <= radius and (theirs := self.root(values[at])) != mine:
                self.parent[theirs] = mine
                if values[at] != value:
                    yield values[at], value
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(child)


def shard_links(left: list[int], right: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links of a forest that joins all values of a shard within the radius of each other, directly or in steps.

    Without `right`, all pairs within `left`; else all pairs of one side with the other (links within `left`, which
    another shard gives, are followed but not given).
    """
    out = []
    tree = BKTree(radius)
    for v in left:
        links = list(tree.join(v))
        tree.add(v)
        if right is None:
            out += links
    for v in right or ():
        out += tree.join(v)
    return out


def _blocks(count: int, radius: int) -> int:
    """r, the number of blocks in a shard's key."""
    r = 1
    while count / 2 ** (64 * r / (radius + r)) > SHARD_ROWS and r < 5:
        r += 1
    return r


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def fingerprint_links(fps: DataFrame, count: int, radius: int = RADIUS, cap: int = SHARD_CAP) -> DataFrame:
    """(src, dst) over distinct fingerprints (column fp): a forest of every shard's links."""
    r = _blocks(count, radius)
    n = radius + r
    cuts = [round(64 * k / n) for k in range(n + 1)]
    masks = [sum(((1 << cuts[k + 1]) - (1 << cuts[k])) for k in chosen) for chosen in combinations(range(n), r)]
    rows = fps.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])).alias("s"),
    ).select("fp", "s.band", "s.key")
    return _searched(rows, radius, cap)


def tables(count: int) -> tuple[int, int]:
    """(sampled bits, tables) of wide fingerprints: pairs of similarity SIMILAR meet with the probability MEET."""
    bits = max(6, math.ceil(math.log2(max(count, 1) / WIDE_SHARD)))
    met = (1 - math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - MEET) / math.log(1 - met))


def wide_links(fps: DataFrame, count: int, radius: int = WIDE_RADIUS, cap: int = SHARD_CAP) -> DataFrame:
    """(src, dst) over distinct wide fingerprints (column fp): a forest of every shard's links."""
    ship(fps.sparkSession)
    bits, many = tables(count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(11)
        chosen = [rng.choice(WIDE, bits, replace=False) for _ in range(many)]
        for b in batches:
            raw = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(len(b.column(0)), -1)
            each = np.unpackbits(raw, axis=1)
            for band, at in enumerate(chosen):
                key = each[:, at] @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(key), band, np.int32)), pa.array(key)], ["fp", "band", "key"])

    return _searched(fps.select("fp").mapInArrow(run, "fp binary, band int, key long"), radius, cap)


def _searched(rows: DataFrame, radius: int, cap: int) -> DataFrame:
    """(src, dst) of rows (fp, band, key): the links of every shard (band, key), or pair of parts of a hot one."""
    ship(rows.sparkSession)
    hot = materialize(rows.groupBy("band", "key").agg(F.count("*").alias("m")).filter(F.col("m") > cap), "simhash-hot")
    parts = F.coalesce(F.ceil(F.col("m") / cap), F.lit(1)).cast("int")
    placed = (
        rows.join(small_side(hot), ["band", "key"], "left")
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "band", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"),
            (F.col("own") > F.col("other")).alias("second"), "fp",
        )
    )
    group = ["band", "key", "a", "b"]
    kind = dict(rows.dtypes)["fp"]
    wide = kind == "binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (lambda fp: int.from_bytes(fp, "big")) if wide else (lambda fp: fp & MASK)
        value = (lambda x: x.to_bytes(WIDE // 8, "big")) if wide else _signed
        now, left, right = None, [], []

        def done() -> list[tuple[int, int]]:
            return shard_links(left, right if now and now[2] != now[3] else None, radius) if len(left) + len(right) > 1 else []

        def pairs(out: list[tuple[int, int]]) -> pa.RecordBatch:
            sides = [pa.array([value(p[k]) for p in out], pa.binary() if wide else pa.int64()) for k in (0, 1)]
            return pa.RecordBatch.from_arrays(sides, ["src", "dst"])

        for b in batches:
            out = []
            for *key, second, fp in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if key != now:
                    out += done()
                    now, left, right = key, [], []
                (right if second else left).append(number(fp))
            if out:
                yield pairs(out)
        if out := done():
            yield pairs(out)

    searched = placed.repartition(*group).sortWithinPartitions(*group, "second", "fp")
    return searched.mapInArrow(run, ", ".join(f"{side} {'binary' if wide else 'long'}" for side in ("src", "dst"))).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the links (src, dst): root is the smallest node reachable.

    Alternating star contraction: each node's larger neighbours, then its smaller ones, are moved to the smallest
    neighbour, until no row changes. Every round is one written table; rows never outnumber the links.
    """
    edges = links.filter("src <> dst").select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    edges = materialize(edges, label)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.filter("v > u").join(least, "u").filter("v <> m")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        large = materialize(large, label)
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(down, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.*").filter("hi <> lo").distinct()
        )
        small = materialize(small, label)
        n, same, both_n = (small.count(), small.join(edges, ["hi", "lo"], "left_semi").count(), edges.count())
        edges = small
        if n == same == both_n:
            return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id, root) for every row of docs; component_id is the smallest doc_id reachable.

    Classes that repeat a doc_id over differing texts may share a component_id; root tells them apart.
    """
    each = materialize(fingerprints(docs, shingle).drop("h"), "simhash-fp")
    distinct = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(fingerprint_links(distinct, distinct.count(), radius), "simhash-cc")
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    linked = labelled.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = materialize(labelled.join(linked, "root").select("fp", "component_id", "root"), "simhash-named")
    return each.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def dedup_documents(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = WIDE_RADIUS, shingle: int = WIDE_SHINGLE) -> DataFrame:
    """One row of each class of near copies: with the smallest doc_id (null only where the class has no other), and of
    that id the text with the smallest hash. Rows that agree in both leave one, any."""
    each = fingerprints(docs, shingle, wide=True).groupBy("doc_id", "h").agg(F.first("fp").alias("fp"), F.count("*").alias("n"))
    each = materialize(each, "simhash-wide")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    distinct = materialize(each.groupBy("fp").agg(F.min(order).alias("best")), "simhash-distinct")
    roots = components(wide_links(distinct, distinct.count(), radius), "simhash-cc")
    labelled = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("best", F.coalesce("root", "fp").alias("root"))
    kept = labelled.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.doc_id").alias("d"), F.col("best.h").alias("g"))
    same = each["doc_id"].eqNullSafe(kept["d"]) & (each["h"] == kept["g"])
    marked = each.join(kept, same, "left").select("doc_id", "h", "n", F.col("g").isNotNull().alias("stays"))
    marked = materialize(marked.filter("not stays or n > 1"), "simhash-marked")
    once = without_rows(docs, marked)
    again = marked.filter("stays")
    if again.isEmpty():
        return once
    name = unused(docs, "hash")
    repeated = docs.join(small_side(again), docs["doc_id"].eqNullSafe(again["doc_id"]) & (text_hash(docs) == again["h"]), "left_semi")
    return once.unionByName(repeated.withColumn(name, text_hash(docs)).dropDuplicates(["doc_id", name]).drop(name))
