"""Secret scans: three fixed patterns, and sliding-window Shannon entropy per character class.

Everything is built-in SQL on one row: no shuffle, no Python. Spans count code points, the end is exclusive.

* Null and empty texts have no spans: counts of 0, the SHA-256 of an empty string, an empty `spans`.
* Repeated rows give repeated results; a null doc_id is kept as it is; further columns are ignored.
* Cost is linear in the length of a text and the number of its matches: places are summed by blocks of BLOCK matches,
  and each window updates the counts of its predecessor by one character in and one out, in pieces of PIECE windows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Matches, and windows, whose places are found in one array.
BLOCK, PIECE = 64, 256
SCALE = 1 << 20
#: Candidates that are known not to be secrets: UUIDs, plain numbers, documented samples, runs of one alphabet.
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]+$",
    r"EXAMPLE",
    r"abcdefghij|ABCDEFGHIJ|0123456789",
)


@dataclass(frozen=True)
class CharClass:
    """Candidates are runs of `charset` of at least `window` characters that match `needs`; a window counts from `bits` on."""

    kind: str
    charset: str
    needs: str
    bits: float


CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", r"[0-9]", 3.025),
    CharClass("entropy_base64", "A-Za-z0-9+/_=-", r"[0-9]", 3.825),
)
WINDOW = 20
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))
_SPAN = "array<struct<start:int,kind:int,end:int>>"
_PLACE = "array<struct<start:int,end:int,hit:string,value:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once; named in a lambda instead, it would be computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blocks(items: Column) -> Column:
    """An array cut into arrays of BLOCK; none if it is empty. `items` has to be a variable of _let."""
    count = F.ceil(F.size(items) / BLOCK).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))).otherwise(
        F.slice(F.array(items), 1, 0)
    )


def _places(text: Column, pattern: str, values: Column | None = None) -> Column:
    """Matches of a pattern in order: array of (start, end, hit, value), null if there is none.

    A match starts after the gaps and matches before it. Their lengths are summed by blocks, then within each block.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    each = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), (hits if values is None else values).alias("value"))

    def placed(blocks: Column) -> Column:
        length = lambda x: F.length(x["gap"]) + F.length(x["hit"])
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + length(x)))
        bases = F.aggregate(
            sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"],
        )

        def within(base: Column, block: Column) -> Column:
            def step(s: Column, x: Column) -> Column:
                start = s["at"] + F.length(x["gap"])
                end = start + F.length(x["hit"])
                place = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), x["value"].alias("value"))
                return F.struct(end.alias("at"), F.concat(s["out"], F.array(place)).alias("out"))

            zero = F.struct(base.alias("at"), F.array().cast(_PLACE).alias("out"))
            return F.aggregate(block, zero, step, lambda s: s["out"])

        return F.flatten(F.zip_with(bases, blocks, within))

    # the gap after the last match has no hit
    found = _let(each, lambda all_: _let(_blocks_of_hits(all_), placed))
    return F.when(text.rlike(pattern), found)


def _blocks_of_hits(all_: Column) -> Column:
    return _let(F.filter(all_, lambda x: x["hit"].isNotNull()), _blocks)


def _spans(places: Column, kind: int, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans of one kind, of those places that are kept."""
    kept = places if keep is None else F.filter(places, keep)
    spans = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))
    return F.coalesce(spans, F.array().cast(_SPAN))


def _entropy_runs(candidate: Column, start: Column, kind: int, c: CharClass, window: int) -> Column:
    """Merged windows of one candidate whose entropy reaches `bits`.

    With n(c) the count of c in the window, H = log2(W) - sum n(c) log2 n(c) / W; the sum is kept in whole units of
    1/SCALE and changed by one entering and one leaving character at each step. Windows go by pieces of PIECE, each of
    which counts its first window anew.
    """
    table = F.array(*[F.lit(round(n * math.log2(n) * SCALE) if n else 0) for n in range(window + 2)])
    most = math.floor(window * (math.log2(window) - c.bits) * SCALE)
    alphabet = _alphabet(c.charset)
    f = lambda n: F.element_at(table, n + 1)

    def piece(codes: Column, first: Column) -> Column:
        """Starts, from 0 in the piece, of its windows that reach `bits`."""

        def step(s: Column, i: Column) -> Column:
            a = F.element_at(codes, i)
            b = F.when(i > window, F.element_at(codes, F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
            had = F.element_at(s["counts"], a)
            left = F.when(b > 0, F.element_at(s["counts"], F.greatest(b, F.lit(1))) + (a == b).cast("int")).otherwise(F.lit(0))
            total = s["total"] + f(had + 1) - f(had) + F.when(left > 0, f(F.greatest(left - 1, F.lit(0))) - f(left)).otherwise(F.lit(0))
            counts = F.transform(s["counts"], lambda n, k: n + (k + 1 == a).cast("int") - (k + 1 == b).cast("int"))
            hit = (i >= window) & (total <= most)
            out = F.when(hit, F.concat(s["out"], F.array(first + i - window))).otherwise(s["out"])
            return F.struct(counts.alias("counts"), total.cast("int").alias("total"), out.alias("out"))

        zero = F.struct(
            F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0).alias("total"), F.array().cast("array<int>").alias("out")
        )
        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), zero, step, lambda s: s["out"])

    def pieces(codes: Column) -> Column:
        count = F.ceil((F.size(codes) - window + 1) / PIECE).cast("int")
        each = lambda p: _let(F.slice(codes, p * PIECE + 1, F.lit(PIECE + window - 1)), lambda mine: piece(mine, p * PIECE))
        return F.flatten(F.transform(F.sequence(F.lit(0), count - 1), each))

    def merged(at: Column) -> Column:
        """Runs of windows that overlap or touch the one before them."""
        far = lambda i, j: F.coalesce(F.abs(F.get(at, j) - F.get(at, i)) > window, F.lit(True))
        starts, ends = F.filter(at, lambda x, i: far(i, i - 1)), F.filter(at, lambda x, i: far(i, i + 1))
        return F.zip_with(
            starts, ends, lambda s, e: F.struct((start + s).alias("start"), F.lit(kind).alias("kind"), (start + e + window).alias("end"))
        )

    codes = F.transform(F.split(candidate, ""), lambda x: F.instr(F.lit(alphabet), x))
    return _let(codes, lambda of: _let(pieces(of), merged))


def _alphabet(charset: str) -> str:
    return "".join(ch for ch in map(chr, range(33, 127)) if re.fullmatch(f"[{charset}]", ch))


def _entropy_spans(text: Column, kind: int, c: CharClass, window: int, allow: tuple[str, ...]) -> Column:
    places = _places(text, f"[{c.charset}]{{{window},}}")
    allowed = lambda x: F.greatest(F.lit(False), F.lit(False), *[x.rlike(a) for a in allow])
    wanted = F.filter(places, lambda p: p["hit"].rlike(c.needs) & ~allowed(p["hit"]))
    runs = F.flatten(F.transform(wanted, lambda p: _entropy_runs(p["hit"], p["start"], kind, c, window)))
    return F.coalesce(runs, F.array().cast(_SPAN))


def scan_spans(
    text: Column, classes: tuple[CharClass, ...] = CLASSES, window: int = WINDOW, allow: tuple[str, ...] = ALLOW
) -> tuple[Column, Column]:
    """(base spans, added spans) of a text, as arrays of (start, kind number in KINDS, end)."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(
        _spans(_places(text, ASSIGN, F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))), 0, lambda x: F.length(x["value"]) >= 6),
        _spans(_places(text, ACCESS), 1),
        _spans(_places(text, HEX), 2),
    )
    added = [_entropy_spans(text, k, c, window, allow) for k, c in enumerate(classes, 3)]
    return F.array_sort(base), F.array_sort(F.concat(*added))


def _clear(more: Column, base: Column) -> Column:
    """Spans of `more` that touch none of `base` (in order): blocks of `base` are passed over by their outer bounds."""

    def outside(blocks: Column) -> Column:
        meets = lambda x, m: (x["start"] < m["end"]) & (m["start"] < x["end"])
        return F.filter(more, lambda m: ~F.exists(blocks, lambda k: meets(k, m) & F.exists(k["spans"], lambda x: meets(x, m))))

    bounded = lambda blocks: F.transform(
        blocks,
        lambda k: F.struct(F.element_at(k, 1)["start"].alias("start"), F.array_max(F.transform(k, lambda x: x["end"])).alias("end"), k.alias("spans")),
    )
    return F.when((F.size(more) > 0) & (F.size(base) > 0), _let(_let(base, lambda all_: bounded(_blocks(all_))), outside)).otherwise(more)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added): base pattern spans, and those entropy spans that touch no base span."""
    base, added = scan_spans(F.col(text_col))
    raw = docs.select(F.col(id_col), base.alias("base"), added.alias("more"))
    return raw.select(id_col, "base", _clear(F.col("more"), F.col("base")).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def scan_documents(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def keep_clean(docs: DataFrame) -> DataFrame:
    """Documents without any span, of the fixed patterns or added. Null and empty texts stay."""
    base, added = scan_spans(F.col("text"))
    return docs.filter(F.size(base) + F.size(added) == 0)
