"""Benchmark decontamination by pigeonhole edit matching.

With an error budget of k edits, a test item is split into k + 1 pieces: an occurrence within the
budget leaves at least one piece untouched. One automaton finds all exact pieces of all items in a
pass over each text; around piece hits, Myers' bit-parallel algorithm computes the edit distance of the
whole item to the stretch of the text that ends at each place.

Occurrences of an item don't overlap and are taken from left to right: from the first end within the
budget of k edits on, the nearest end among 2k further places, then what lies behind it.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidewright.llm.common import bounded_batches, fresh, text_of, with_text

#: Least length of a piece in code points; the error budget of an item follows from it.
PIECE = 12
#: Code points of items that one pass over the texts takes; more items take more passes.
BLOCK = 4_000_000


def normalised(text: str) -> str:
    """Lower case, white space as single spaces."""
    return " ".join(text.lower().split())


def budget(length: int, piece: int = PIECE) -> int:
    """Edits that an item of this length may have: about one in each piece but one."""
    return max(0, length // piece - 1)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, text) of the k + 1 pieces, as equal as possible."""
    cuts = [len(item) * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@functools.lru_cache(4096)
def _masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for k, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << k
    return out


def distances(item: str, text: str) -> Iterator[int]:
    """For each place of text, the least edit distance of item to a stretch that ends behind it. item
    isn't empty."""
    m = len(item)
    masks, full, top = _masks(item), (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        yield score
        ph, mh = ph << 1 & full, mh << 1 & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv


def myers(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the stretch of text nearest to item, the first such end; the empty stretch
    at 0 counts."""
    best, end = len(item), 0
    for at, score in enumerate(distances(item, text) if item else (), 1):
        if score < best:
            best, end = score, at
    return best, end


def first_within(item: str, text: str, k: int) -> tuple[int, int] | None:
    """(distance, end): from the first end within k edits on, the nearest among 2k further places, which
    all belong to one occurrence."""
    best, end, last = k + 1, 0, len(text)
    for at, score in enumerate(distances(item, text), 1):
        if score < best:
            if best > k:
                last = at + 2 * k
            best, end = score, at
        if at == last or not best:
            break
    return (best, end) if best <= k else None


@dataclasses.dataclass(frozen=True)
class Hit:
    item: object
    distance: int
    start: int
    end: int


class Matcher:
    """The pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[object, str]], piece: int = PIECE):
        import ahocorasick

        self.items: list[tuple[object, str, int]] = []
        found: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            text = normalised(text)
            if not text:
                continue  # nothing to find
            k = budget(len(text), piece)
            for at, part in pieces(text, k):
                found.setdefault(part, []).append((len(self.items), at))
            self.items.append((key, text, k))
        self.machine = ahocorasick.Automaton()
        for part, where in found.items():
            self.machine.add_word(part, (len(part), tuple(where)))
        if found:
            self.machine.make_automaton()
        self.empty = not found
        self.piece = piece

    def search(self, text: str) -> list[Hit]:
        """The occurrences of each item within its budget, by item and place. Items shorter than a piece
        must stand between word ends."""
        if self.empty:
            return []
        text = normalised(text)
        diagonals: dict[int, set[int]] = {}
        for end, (size, where) in self.machine.iter(text):
            for item, at in where:
                diagonals.setdefault(item, set()).add(end + 1 - size - at)
        return [hit for item in sorted(diagonals) for hit in self._occurrences(text, item, sorted(diagonals[item]))]

    def _occurrences(self, text: str, item: int, starts: list[int]) -> Iterator[Hit]:
        """starts: where the item would begin, by its piece hits. Stretches of the text that overlap are
        searched as one, so no part is read more than a few times however many hits there are."""
        key, own, k = self.items[item]
        size = len(own)
        if size < self.piece:
            behind = 0
            for d in starts:
                if d >= behind and self._alone(text, d, d + size):
                    behind = d + size
                    yield Hit(key, 0, d, behind)
            return
        stretches: list[list[int]] = []
        for d in starts:
            lo, hi = max(0, d - k), min(len(text), d + size + k)
            if stretches and lo <= stretches[-1][1]:
                stretches[-1][1] = max(hi, stretches[-1][1])
            else:
                stretches.append([lo, hi])
        for lo, hi in stretches:
            while hi - lo >= size - k and (found := first_within(own, text[lo:hi], k)):
                distance, end = found
                _, back = myers(own[::-1], text[max(lo, lo + end - size - k) : lo + end][::-1]) if distance else (0, size)
                yield Hit(key, distance, lo + end - back, lo + end)
                lo += end

    @staticmethod
    def _alone(text: str, start: int, end: int) -> bool:
        return not (text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())


@functools.lru_cache(4)
def _matcher(items: tuple[tuple[object, str], ...], piece: int) -> Matcher:
    return Matcher(list(items), piece)


def blocks_of(benchmark: DataFrame, text: str, key: str, block: int) -> Iterator[list[tuple[object, str]]]:
    """The items, in blocks of bounded size."""
    held, size = [], 0
    for row in benchmark.select(F.col(key).alias("k"), text_of(benchmark[text]).alias("t")).where("t <> ''").distinct().orderBy("k", "t").toLocalIterator():
        if held and size + len(row["t"]) > block:
            yield held
            held, size = [], 0
        held.append((row["k"], row["t"]))
        size += len(row["t"])
    if held:
        yield held


def find(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "item_id", item_text: str = "text", piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """docs with leaks: for each occurrence of an item in the text within its error budget (item_id,
    distance, start, end), the place in code points of the normalised text.

    Null texts count as empty and have no leaks; empty items are found nowhere; item_id has the type that
    the benchmark gives it, and a null one stays null; items that repeat with one id and text count
    once; an empty benchmark or documents table gives empty lists or an empty result. Texts and items
    are read whole. A column named leaks is replaced.
    """
    return _found(docs, benchmark, "leaks", text, key, item_text, piece, block)


def _found(docs: DataFrame, benchmark: DataFrame, name: str, text: str, key: str, item_text: str, piece: int, block: int) -> DataFrame:
    bounded_batches(docs.sparkSession)
    kind = benchmark.schema[key].dataType
    out = docs.drop(name).withColumn(name, F.array().cast(f"array<struct<item_id:{kind.simpleString()},distance:int,start:bigint,end:bigint>>"))
    for items in blocks_of(benchmark, item_text, key, block):
        out = _searched(out, docs.sparkSession.sparkContext.broadcast(tuple(items)), text, piece, to_arrow_type(kind))
    return out


def _searched(docs: DataFrame, shared, text: str, piece: int, id_kind: pa.DataType) -> DataFrame:
    """docs, whose last column lists what was found before, with what this block of items adds."""
    kind = pa.list_(pa.struct([("item_id", id_kind), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared.value, piece)
        for b in batches:
            *rest, before, texts = b.columns
            out = []
            for t, old in zip(texts.to_pylist(), before.to_pylist(), strict=True):
                out.append((old or []) + [{"item_id": h.item, "distance": h.distance, "start": h.start, "end": h.end} for h in matcher.search(t)])
            yield pa.RecordBatch.from_arrays([*rest, pa.array(out, kind)], names=b.schema.names[:-1])

    return with_text(docs, text)[0].mapInArrow(run, docs.schema)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "item_id", item_text: str = "text", piece: int = PIECE, block: int = BLOCK) -> DataFrame:
    """The rows of docs without any occurrence of a test item, with all their columns; nulls, repeats
    and empty tables as in find()."""
    name = fresh(docs.columns, "_leaks")
    return _found(docs, benchmark, name, text, key, item_text, piece, block).where(F.size(name) == 0).drop(name)
