"""SentencePiece BPE encoding and decoding by a prefix table.

For each prefix of a segment the table keeps the last token of that prefix's encoding. It is unique: of the pieces that
an Aho-Corasick automaton finds ending there, the one that is compatible with the last token where the piece begins.
Two tokens are compatible if merging their joined characters by score never joins across them; an encoding is
right exactly if all neighbours are compatible, since the first merge across a boundary sees only the two tokens
beside it. The ids are then recovered backwards from the end.

A text is first cut at places that no piece of the vocabulary spans (before a run of spaces, and between characters
that never meet inside a piece), so segments repeat and are kept in a bounded table in each Python worker.

A null text counts as empty; an empty text has no ids and decodes to an empty text. Repeated rows repeat in the result,
a null doc_id is kept, an empty table gives an empty result, further columns are ignored. Time is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain, islice, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.shared import ship

SPACE = "▁"
#: Segments and token pairs that a worker remembers; beyond it the table starts anew.
SEGMENTS, PAIRS, LONGEST = 300_000, 250_000, 48
#: Words that are worked on together; a longer text goes on in further steps.
STEP = 100_000
_SHIFT = 24
_WORDS = re.compile(f"{SPACE}+[^{SPACE}]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class _Segments(dict):
    """Ids of segments, as bytes of int32."""

    def __init__(self, codec: Codec) -> None:
        super().__init__()
        self.codec = codec

    def __missing__(self, segment: str) -> bytes:
        out = array("i", self.codec.encode_segment(segment)).tobytes()
        if len(segment) <= LONGEST:
            if len(self) >= SEGMENTS:
                self.clear()
            self[segment] = out
        return out


class Codec:
    """Encoder and decoder of one model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model: bytes) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.unknown, self.control = sp.unk_id(), {i for i in range(len(self.pieces)) if sp.is_control(i)}
        self.bytes = {int(_BYTE.fullmatch(p)[1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        special = self.control | set(self.byte_of) | {self.unknown}
        self.ids = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()
        self.alphabet = {p for p in self.ids if len(p) == 1}
        self.plain, self.shown = set(self.ids.values()), [p.replace(SPACE, " ") for p in self.pieces]
        self.cut = re.compile(self._cuts())
        self.pairs: dict[int, bool] = {}
        self.traces: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.segments = _Segments(self)
        self.numbers = pa.array([f"{i}," for i in range(len(self.pieces))], pa.large_string())
        self.raw = pa.array([self._bytes_of(i) for i in range(len(self.pieces))], pa.large_binary())

    def _bytes_of(self, token: int) -> bytes:
        if token in self.byte_of:
            return bytes([self.byte_of[token]])
        return b"" if token in self.control else " ⁇ ".encode() if token == self.unknown else self.shown[token].encode()

    def forget(self) -> None:
        """Drop all that was remembered of texts, and give memory back."""
        self.segments.clear()
        self.pairs.clear()
        self.traces.clear()
        pa.default_memory_pool().release_unused()

    def _cuts(self) -> str:
        """Segments: spaces, then marks, then other characters; before a mark there's a cut, but for the few characters
        that some piece holds before a mark."""
        meets = {pair for p in self.ids for pair in zip(p, p[1:])}  # noqa: B905
        if any(b == SPACE and a != SPACE for a, b in meets):
            raise ValueError("a piece holds a space after another character; texts can't be cut at spaces")
        marks = {c for p in self.ids for c in p if unicodedata.category(c)[0] in "PS" and c != SPACE} | {"\n"}
        before = {a for a, b in meets if b in marks and a not in marks and a != SPACE}
        group = lambda chars: "".join(map(re.escape, sorted(chars)))
        s, held = group(marks), f"(?:(?<=[{group(before)}])[{group(marks)}]+)?" if before else ""
        return f"{SPACE}*[{s}]*(?:[^{SPACE}{s}]+{held})+|{SPACE}*[{s}]+|{SPACE}+"

    def trace(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """The merges that make a token of its characters, by the highest score and leftmost first: their scores, and
        the parts at its left and right edge before each and after the last. None if they don't make the token."""
        if token in self.traces:
            return self.traces[token]
        parts = list(self.pieces[token])
        scores, lefts, rights = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            lefts.append(parts[0])
            rights.append(parts[-1])
        out = self.traces[token] = (scores, lefts, rights) if len(parts) == 1 else None
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether no merge crosses the boundary of two tokens while both grow; left: -1 at the start of a run.

        Both traces run side by side, the higher score first and the left one on a tie. A merge of the two parts at
        the boundary comes between them.
        """
        key = (left + 1) << _SHIFT | right
        known = self.pairs.get(key)
        if known is None:
            known = self._grow_apart(self.trace(left) if left >= 0 else ([], [], [""]), self.trace(right))
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _grow_apart(self, one, two) -> bool:
        if one is None or two is None:
            return False
        (s1, _, edge1), (s2, edge2, _) = one, two
        n1, n2, i, j = len(s1), len(s2), 0, 0
        least = float("-inf")
        while True:
            across = self.score.get(edge1[i] + edge2[j], least) if edge1[i] else least
            a, b = s1[i] if i < n1 else least, s2[j] if j < n2 else least
            if a >= across and a >= b and i < n1:
                i += 1
            elif across > least and across >= b:
                return False
            elif j < n2:
                j += 1
            else:
                return True

    def _known(self, run: str) -> list[int]:
        """Ids of a run of characters that are all in the vocabulary."""
        n = len(run)
        # tokens are kept one up, so that 0 stands for the start and -1 for a prefix that isn't reached
        last, begin = [-1] * (n + 1), [0] * (n + 1)
        last[0] = 0
        known = self.pairs.get
        for end, (token, size) in self.automaton.iter(run):
            at = end + 1
            if last[at] < 0 and (before := last[at - size]) >= 0:
                fits = known(before << _SHIFT | token)
                if self.compatible(before - 1, token) if fits is None else fits:
                    last[at], begin[at] = token + 1, at - size
        ids = []
        while n:
            ids.append(last[n] - 1)
            n = begin[n]
        return ids[::-1]

    def encode_segment(self, segment: str) -> list[int]:
        out: list[int] = []
        if self.alphabet.issuperset(segment):
            return self._known(segment)
        start = 0
        for k, c in enumerate(segment):
            if c not in self.alphabet:
                if k > start:
                    out += self._known(segment[start:k])
                out += [self.bytes[b] for b in c.encode("utf-8", "replace")] if self.bytes else [self.unknown]
                start = k + 1
        if start < len(segment):
            out += self._known(segment[start:])
        return out

    def surface(self, ids: Sequence[int]) -> str:
        """Text of ids anywhere but at the start: byte runs as UTF-8, each byte that is none as U+FFFD."""
        if self.plain.issuperset(ids):
            return "".join([self.shown[i] for i in ids])
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:size]).decode())
                    except UnicodeDecodeError:
                        continue
                    del run[:size]
                    break
                else:
                    out.append("�")
                    del run[:1]
            if i >= 0 and i not in self.control:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def ids_of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each); each distinct one is looked up once."""
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        known = list(map(self._word, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.frombuffer(b"".join(known), "<i4"))
        codes = coded.indices
        return lists.take(codes).flatten().to_numpy(), sizes[codes.to_numpy()]

    def _word(self, word: str) -> bytes:
        if word[1:].isalnum():
            return self.segments[word]
        return b"".join(map(self.segments.__getitem__, self.cut.findall(word)))

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for part in (_steps(text) if text else ()) for i in self.ids_of(part)[0]]

    def decode(self, ids: Sequence[int]) -> str:
        text = self.surface(ids)
        return text[1:] if ids and self.pieces[ids[0]].startswith(SPACE) else text

    def digest(self, texts: Iterable[str | None], with_ids: bool) -> tuple[list[int], list[np.ndarray], list[str], list[str]]:
        """For each text: number of ids, ids (if wanted), digest of the ids and of the text that they decode to."""
        out: tuple = ([], [], [], [])
        group: list[tuple[int, list[str]]] = []  # words of whole texts, for a step together

        def flush() -> None:
            ids, sizes = self.ids_of([s for _, part in group for s in part])
            ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *(n for n, _ in group)])]
            for row in self._digests(ids, ends, with_ids):
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            group.clear()

        waiting = 0
        for text in texts:
            parts = _steps(text) if text else iter(([],))
            first = next(parts, [])
            if waiting + len(first) > STEP and group:
                flush()
                waiting = 0
            more = next(parts, None)
            if more is None:
                group.append((len(first), first))
                waiting += len(first)
                continue
            if group:
                flush()
                waiting = 0
            ids = np.concatenate([self.ids_of(part)[0] for part in chain((first, more), parts)])
            for column, value in zip(out, next(iter(self._digests(ids, np.array([0, len(ids)]), with_ids))), strict=True):
                column.append(value)
        if group:
            flush()
        return out

    def _digests(self, ids: np.ndarray, ends: np.ndarray, with_ids: bool) -> Iterator[tuple]:
        """(number, ids, digest of ids, digest of the decoded text) of each stretch ids[ends[k]:ends[k + 1]].

        The pieces of ids are laid side by side by one take; only what isn't UTF-8 then is decoded by `surface`.
        """
        numbers, said = (_laid(t, ids) for t in (self.numbers, self.raw))
        for a, b in pairwise(ends.tolist()):
            mine = ids[a:b]
            listed = hashlib.sha256(numbers[1][numbers[0][a] : max(numbers[0][a], numbers[0][b] - 1)]).hexdigest()
            skip = int(b > a and self.pieces[mine[0]].startswith(SPACE))
            raw = said[1][said[0][a] + skip : said[0][b]]
            try:
                str(raw, "utf-8")
            except UnicodeDecodeError:
                raw = self.decode(mine.tolist()).encode()
            yield b - a, mine if with_ids else None, listed, hashlib.sha256(raw).hexdigest()


def _steps(text: str) -> Iterator[list[str]]:
    """The words of a text, each with the spaces before it and one more before the first, STEP at a time."""
    marked = SPACE + text.replace(" ", SPACE)
    if len(marked) <= STEP:
        yield _WORDS.findall(marked)
        return
    found = (m[0] for m in _WORDS.finditer(marked))
    while part := list(islice(found, STEP)):
        yield part


def _laid(table: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """(offsets, bytes) of the table's entries of ids, side by side."""
    taken = table.take(pa.array(ids))
    _, offsets, data = taken.buffers()
    return np.frombuffer(offsets, np.int64)[: len(ids) + 1], memoryview(data or b"")


_CODECS: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """The codec of a model, built once in each process."""
    key = hashlib.sha256(model).digest()
    if key not in _CODECS:
        _CODECS[key] = Codec(model)
    return _CODECS[key]


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def _mapped(docs: DataFrame, model_path: str | None, with_ids: bool) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    with open(model_path or default_model(), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    keep = docs.columns
    fields = [*(f"`{c}` {t}" for c, t in docs.drop("text").dtypes), "n_tokens long", *["ids array<int>"] * with_ids, "ids_sha256 string", "decoded_sha256 string"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(model.value)
        for b in batches:
            counts, ids, id_digests, digests = made.digest((t.as_py() for t in b.column("text")), with_ids)
            cols = [b.column(c) for c in keep if c != "text"] + [pa.array(counts, pa.int64())]
            if with_ids:
                flat = pa.array(np.concatenate(ids or [[]]), pa.int32())
                cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), flat))
            names = [c for c in keep if c != "text"] + ["n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(id_digests, pa.string()), pa.array(digests, pa.string())], names)
        made.forget()  # workers are kept for other stages

    return docs.mapInArrow(run, ", ".join(fields))


def encode_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids and of the text that they decode to."""
    return _mapped(docs.select("doc_id", "text"), model_path, False)


def tokenize_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Documents without their text, with token ids and the digests; columns of these names are replaced."""
    made = ("n_tokens", "ids", "ids_sha256", "decoded_sha256")
    return _mapped(docs.drop(*made), model_path, True)
