"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A ranks file is turned into that library's model: bytes map to the printable characters of the
byte-level alphabet, and every way to join two tokens into a third becomes a merge, ordered by the
rank of the third. So the library merges what a ranks-based tokenizer would. Decoding takes the
library's tokens and reverses the byte table; a token may end inside a character, so bytes are joined
first and read as characters after. Tokens that share a character both cover it in their offsets.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, fresh, with_text

#: Texts that are encoded at a time, and pieces that a worker remembers with their ids.
CALL_ROWS = 64
REMEMBERED = 600_000

# The public split pattern, and what finds the same pieces faster with Python's re in
# texts that hold only the characters below (there, both agree on letters, digits and white space).
COMMON_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
COMMON_FAST = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
COMMON_CHARS = "\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u20ac"


def byte_table() -> list[str]:
    """The character that stands for each byte: itself where it is printable and no space, else the
    next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@functools.cache
def build_tokenizer(path: str, pattern: str | None):
    """The tokenizers library's tokenizer for a ranks file; pattern splits a text into the pieces
    that are encoded separately. Without one, a text is one piece."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks, table = load_ranks(path), byte_table()
    shown = {token: "".join(table[b] for b in token) for token in ranks}
    merges = []
    for token, _ in sorted(ranks.items(), key=lambda x: x[1]):
        merges += [(shown[a], shown[b]) for k in range(1, len(token)) if (a := token[:k]) in ranks and (b := token[k:]) in ranks]
    model = models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True)
    tokenizer = Tokenizer(model)
    to_chars = pre_tokenizers.ByteLevel(add_prefix_space=False, trim_offsets=False, use_regex=False)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), behavior="isolated"), to_chars]) if pattern else to_chars
    return tokenizer


@functools.cache
def _memory(pattern: str, path: str) -> tuple:
    """What finds the pieces of a text of common characters, what finds a character that isn't, and
    the ids of pieces met so far."""
    return (re.compile(COMMON_FAST), re.compile(f"[^{COMMON_CHARS}]"), {}) if pattern == COMMON_PATTERN else (None, None, {})


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id: the characters of the library's token, by the byte table reversed. Ids that
    the file leaves out have none."""
    back = {c: b for b, c in enumerate(byte_table())}
    tokenizer = build_tokenizer(path, None)
    shown = (tokenizer.id_to_token(k) for k in range(max(load_ranks(path).values(), default=-1) + 1))
    return [bytes(map(back.__getitem__, x or "")) for x in shown]


def encode_texts(texts: list[str], path: str, pattern: str, offsets: bool = True) -> list[tuple[bytes, bytes]]:
    """Of each text the ids and, if wanted, for each token the start and end of the code points that it
    covers or shares, all as little-endian unsigned 32 bits. In texts of common characters the pieces are found
    first, and only those not met before go through the library: words repeat."""
    finder, odd, memory = _memory(pattern, path)
    plain = [finder is not None and not odd.search(text) for text in texts]
    rest = iter(encode_whole([t for t, p in zip(texts, plain, strict=True) if not p], path, pattern))
    pieces = [finder.findall(t) if p else None for t, p in zip(texts, plain, strict=True)]
    new = list({p for found in pieces if found for p in found if p not in memory})
    if len(memory) + len(new) > REMEMBERED:
        memory.clear()
        new = list({p for found in pieces if found for p in found})
    if new:
        memory.update(zip(new, encode_whole(new, path, None), strict=True))
    return [next(rest) if found is None else _joined([memory[p] for p in found], found, offsets) for found in pieces]


def _joined(parts: list[tuple[bytes, bytes]], pieces: list[str], offsets: bool) -> tuple[bytes, bytes]:
    ids = b"".join([x for x, _ in parts])
    if not offsets:
        return ids, b""
    spans = np.frombuffer(b"".join([x for _, x in parts]), "<u4")
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    counts = np.fromiter([len(x) for _, x in parts], np.int64, len(parts)) // 4
    return ids, (spans + np.repeat(np.cumsum(sizes) - sizes, counts).astype("<u4")).tobytes()


def encode_whole(texts: list[str], path: str, pattern: str | None) -> list[tuple[bytes, bytes]]:
    """The same by the library alone."""
    found = build_tokenizer(path, pattern).encode_batch(texts, add_special_tokens=False)
    return [(np.array(x.ids, dtype="<u4").tobytes(), np.array(x.offsets, dtype="<u4").tobytes()) for x in found]


def decode_ids(ids: bytes, path: str) -> bytes:
    """The bytes that ids stand for, a character that tokens share included."""
    return b"".join(map(token_bytes(path).__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def _one_thread() -> None:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", offsets: bool = False) -> DataFrame:
    """docs with ids_le (binary, each id as little-endian unsigned 32 bits), n_tokens and, if asked for,
    offsets_le (binary, start and end in code points of each token, written alike). Null texts count
    as empty and have no tokens; repeated rows are encoded each; an empty table gives an empty result.
    Columns of docs that bear one of these names are replaced."""
    return _mapped(docs, path, pattern, text, offsets, False)


def round_trip(docs: DataFrame, path: str, pattern: str, *, text: str = "text", offsets: bool = False) -> DataFrame:
    """The same with decoded (binary), made from the ids alone."""
    return _mapped(docs, path, pattern, text, offsets, True)


def decode(docs: DataFrame, path: str, *, ids: str = "ids_le") -> DataFrame:
    """docs with decoded (binary) made from ids_le, and decoded_text, in which a character of which ids
    have only a part is U+FFFD. Null ids give empty ones; columns named so before are replaced."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [decode_ids(x or b"", path) for x in batch.column(batch.num_columns - 1).to_pylist()]
            more = [pa.array(out, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=[*batch.schema.names[:-1], "decoded", "decoded_text"])

    kept = docs.drop("decoded", "decoded_text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema), "decoded binary", "decoded_text string"])
    return kept.withColumn(fresh(kept.columns, "_ids"), F.col(ids)).mapInArrow(run, schema)


def _mapped(docs: DataFrame, path: str, pattern: str, text: str, offsets: bool, back: bool) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _one_thread()
        for whole in batches:
            for at in range(0, whole.num_rows, CALL_ROWS):
                batch = whole.slice(at, CALL_ROWS)
                found = encode_texts(batch.column(batch.num_columns - 1).to_pylist(), path, pattern, offsets)
                more = {"ids_le": pa.array([x for x, _ in found], pa.binary()), "n_tokens": pa.array([len(x) // 4 for x, _ in found], pa.int64())}
                if offsets:
                    more["offsets_le"] = pa.array([x for _, x in found], pa.binary())
                if back:
                    more["decoded"] = pa.array([decode_ids(x, path) for x, _ in found], pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more.values()], names=[*batch.schema.names[:-1], *more])

    added = ["ids_le binary", "n_tokens bigint"] + ["offsets_le binary"] * offsets + ["decoded binary"] * back
    rows, types = with_text(docs, text, tuple(x.split()[0] for x in added))
    return rows.mapInArrow(run, ", ".join([*types, *added]))
