"""SimHash near-dedup by covering locality-sensitive hashing.

Each of the 2^(r+1)-1 tables of a radius r keeps the fingerprint bits of one structured mask: bit i
gets a vector phi(i) over GF(2) of r+1 dimensions, and the table of v keeps the bits whose phi(i)
has an odd product with v. Up to r differing bits span at most r dimensions, so some v is orthogonal
to all of them, and the pair agrees on that table's mask: no pair within the radius is missed.
Fingerprints cut into parts use fewer tables: one part has at most its share of the differing bits.

A bucket holds distinct fingerprints only, and links are reported as a spanning forest of each
bucket, never as all its pairs. A bucket that outgrows BUCKET is dealt out again by blocks of the
bits outside its mask: of r+1 blocks, a pair within the radius agrees on one. So no bucket is cut
short, and no task holds more than BUCKET fingerprints of one.

Near-duplicates by similarity are found by the same covering masks, on a wide fingerprint of the set of
shingles: of its words of 64 bits one has at most its share of RADIUS differing bits, so each pair within
RADIUS shares the key of one mask. Pairs of the similarity may lie beyond: at 0.8 they differ in 39 of
256 bits on average, and masks for that many would be more than any table holds. For these alone each of
TABLES further tables has a key made of MINIMA minima of random orders of the set, and two sets of
Jaccard similarity J share a table's key with probability J^MINIMA, wherever a text was edited, extended
or cut. What is dealt out by key is a text's digest; only texts that share a key travel as points.

The wide fingerprint also orders the pairs of a bucket and rules out those that are far apart by any
measure; every other link is decided by exact Jaccard similarity: first the edges of each bucket's
minimum spanning forest, which unite most texts that belong together, then all pairs of a bucket whose
texts these leave in different components. So each pair that shares a key is linked, refuted, or in one
component by other links.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, cut, keep, scratch, text_of
from tidewright.llm.components import connected_components

SEED = 42
#: Fingerprints of one bucket that a task compares; more are dealt out again.
BUCKET = 4096
#: Bits of the wide fingerprint that estimates similarity, as 64-bit words.
WIDE = 4
#: For near-duplicates by similarity: words of a shingle, least similarity, and differing bits of the wide
#: fingerprint that masks cover, four in one of its words.
WORDS, SIMILARITY, RADIUS = 5, 0.8, 5 * WIDE - 1
#: For pairs beyond: tables, and the minima that make a key. A pair of exactly the least similarity shares
#: none of these keys with probability (1 - 0.8^5)^48 = 5e-9.
TABLES, MINIMA = 48, 5
#: Standard deviations of the wide distance beyond which a pair needs no exact look, and document ids
#: that are sent to all tasks; more are joined.
DOUBT, SENT = 6.0, 2_000_000
#: Bytes of shingles that a task holds to decide what is left open in a bucket; more are dealt out by shares.
SHARE_BYTES = 64 << 20
#: Words of a point of near-duplicates: digest and size of the shingle set, wide fingerprint.
SET = 2 + WIDE
_RANDOM = np.random.default_rng(SEED).integers(0, 2**64, (2, TABLES * MINIMA, 1), np.uint64)
_FLIP, _ODD = _RANDOM[0], _RANDOM[1] | np.uint64(1)



# -- fingerprints ---------------------------------------------------------------------------------


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of size words joined by spaces, repeats included; of the whole sequence
    where it is shorter; none without words."""
    from xxhash import xxh64_intdigest as digest

    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if set in over half the hashes; zero without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # very long texts in slices
        ones += np.unpackbits(hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th further hash of each hash (a splitmix64 step)."""
    z = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = 4) -> DataFrame:
    """(key, fp long) for each row of docs: the 64-bit SimHash of its whole text. Null and empty
    texts have fingerprint zero."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [signed(majority(shingle_hashes(words_of(t), size))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=[key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), text_of(docs[text]).alias("_text")).mapInArrow(run, f"`{key}` {kind}, fp bigint")


def table_keys(hashes: np.ndarray) -> np.ndarray:
    """The key of a set of hashes in each table, no two tables having keys in common."""
    least = np.full(TABLES * MINIMA, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(least, ((hashes[at : at + 256] ^ _FLIP) * _ODD).min(1), out=least)
    keys = np.arange(TABLES, dtype=np.uint64)
    for k, x in enumerate(least.reshape(TABLES, MINIMA).T):
        keys = _mixed(keys ^ x, k)
    return keys


def set_of(text: str, size: int) -> tuple[np.ndarray, int]:
    """The hashes of a text's shingles, sorted and without repeats, and their digest."""
    from xxhash import xxh64_intdigest as digest

    h = np.unique(shingle_hashes(words_of(text), size))
    return h, digest(h.tobytes(), SEED)


def set_points(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = WORDS) -> DataFrame:
    """(key, point binary, keys array of long): digest, size and wide fingerprint of the set of shingles
    of size words, in SET words of 64 bits, and its table keys; null without words."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, keys = [], []
            for t in b.column(1).to_pylist():
                h, digest = set_of(t, size)
                points.append(np.array([digest, len(h), *(majority(_mixed(h, k)) for k in range(WIDE))], ">u8").tobytes() if len(h) else None)
                keys.append(table_keys(h).astype(np.int64) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(points, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=[key, "point", "keys"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), text_of(docs[text]).alias("_text")).mapInArrow(run, f"`{key}` {kind}, point binary, keys array<bigint>")


# -- masks ----------------------------------------------------------------------------------------


def covering_masks(radius: int, parts: int = 1, bits: int = 64) -> list[int]:
    """Masks over bits such that two numbers within the radius agree on all bits of one of them."""
    masks = []
    for part in range(parts):
        own = range(part * bits // parts, (part + 1) * bits // parts)
        r = radius // parts  # one part has no more of the differing bits
        phi = {i: (i - own.start) % ((1 << (r + 1)) - 1) + 1 for i in own}
        masks += [sum(1 << i for i in own if (phi[i] & v).bit_count() & 1) for v in range(1, 1 << (r + 1))]
    return masks


def block_masks(fixed: int, radius: int, bits: int = 64) -> list[int]:
    """Masks that each add one of radius + 1 blocks of the free bits to fixed; fewer blocks, of one
    bit each, when fewer bits are free than that."""
    free = [i for i in range(bits) if not fixed >> i & 1]
    n = radius + 1
    blocks = [free[k * len(free) // n : (k + 1) * len(free) // n] for k in range(n)]
    return [fixed | sum(1 << i for i in b) for b in blocks]


# -- links ----------------------------------------------------------------------------------------
# A point is a fingerprint as 8 bytes, big-endian.


def _point_array(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long points as rows of 64-bit words."""
    first = int(np.frombuffer(column.buffers()[1], np.int32)[column.offset])
    return np.frombuffer(column.buffers()[2], ">u8", width * len(column), first).astype(np.uint64).reshape(-1, width)


def forest(points: np.ndarray, radius: int, most: int) -> list[tuple[int, int, int]]:
    """Edges (row numbers, and how many bits the other words differ in) of a minimum spanning forest
    of the graph that links rows whose first words differ in no more than radius bits and whose other
    words in no more than most. Grown from one row at a time, it needs no list of pairs."""
    n, far = len(points), 1 << 30
    if n == 2:
        d = np.bitwise_count(points[0] ^ points[1]).astype(int)
        return [(0, 1, int(d[1:].sum()))] if d[0] <= radius and d[1:].sum() <= most else []
    fps, wide = np.ascontiguousarray(points[:, 0]), points[:, 1:]
    edges, left = [], np.arange(1, n)
    best, to = np.full(n - 1, far), np.zeros(n - 1, np.int64)
    at = 0
    while len(left):
        near = np.flatnonzero(np.bitwise_count(fps[left] ^ fps[at]) <= radius)
        if len(near):
            d = np.bitwise_count(wide[left[near]] ^ wide[at]).sum(1, dtype=np.int64)
            closer = (d <= most) & (d < best[near])
            best[near[closer]], to[near[closer]] = d[closer], at
        k = int(best.argmin())
        at = int(left[k])
        if best[k] < far:
            edges.append((int(to[k]), at, int(best[k])))
        left, best, to = (np.delete(x, k) for x in (left, best, to))
    return edges


def _scan(batches: Iterator[pa.RecordBatch], radius: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask, part, point) sorted by bucket in, rows (a, b, mask) out: links, with mask null, and
    the members of outgrown buckets as (point, null, mask)."""
    out: list[list] = [[], [], []]
    held: list[np.ndarray] = []
    now, size = None, 0

    def tell(a: list, b: list, mask: int | None) -> None:
        out[0].extend(a)
        out[1].extend(b)
        out[2].extend([mask] * len(a))

    def close() -> None:
        if held and size >= 2:
            points = np.concatenate(held)
            if edges := forest(points, radius, 0):
                raw = points.astype(">u8").tobytes()
                one = [raw[8 * k : 8 * (k + 1)] for k in range(len(points))]
                tell([one[x] for x, _, _ in edges], [one[y] for _, y, _ in edges], None)
        held.clear()

    def flush() -> pa.RecordBatch:
        kinds = pa.binary(), pa.binary(), pa.int64()
        batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["a", "b", "mask"])
        for x in out:
            x.clear()
        return batch

    for b in batches:
        if not b.num_rows:
            continue
        mask, part, points = b.column(0).to_numpy(), b.column(1).to_numpy(), _point_array(b.column(2), 1)
        starts = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
        for lo, hi in zip([0, *starts.tolist()], [*starts.tolist(), len(mask)], strict=True):
            if (key := (mask[lo], part[lo])) != now:
                close()
                now, size = key, 0
            size += hi - lo
            held.append(points[lo:hi])
            if size > bucket:  # over the bound: all of it goes back
                raw = np.concatenate(held).astype(">u8").tobytes()
                again = [raw[k : k + 8] for k in range(0, len(raw), 8)]
                tell(again, [None] * len(again), int(mask[lo]))
                held.clear()
            if len(out[0]) > 20_000:
                yield flush()
    close()
    yield flush()


def links(points: DataFrame, radius: int, *, parts: int = 1, bucket: int = BUCKET) -> DataFrame:
    """points: distinct points. Edges (a, b) whose components are those of all links."""
    bounded_batches(points.sparkSession)
    each = lambda masks: F.array(*(F.lit(signed(m)) for m in masks))
    rows = points.select(F.explode(each(covering_masks(radius, parts))).alias("mask"), "point")
    found = None
    while True:
        word = F.conv(F.hex(F.substring("point", 1, 8)), 16, -10).cast("long")
        dealt = rows.select("mask", word.bitwiseAND(F.col("mask")).alias("part"), "point").repartition("mask", "part").sortWithinPartitions("mask", "part")
        done = cut(dealt.mapInArrow(lambda batches: _scan(batches, radius, bucket), "a binary, b binary, mask bigint"), "links")
        linked = done.where("mask is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        found = linked if found is None else found.unionByName(linked)
        over = done.where("mask is not null").select(F.col("a").alias("point"), "mask")
        fixed = [r[0] for r in over.select("mask").distinct().collect()]  # masks, never more than were made
        if not fixed:
            return found.distinct()
        finer = F.create_map(*(x for m in fixed for x in (F.lit(m), each(block_masks(m & (2**64 - 1), radius)))))
        rows = over.select("point", F.explode(finer[F.col("mask")]).alias("mask")).distinct()


def _classes(points: DataFrame, edges: DataFrame, rows: int) -> DataFrame:
    """points (point, least): (point, component_id), the least key of the point's component. rows: how
    many points there are at most."""
    member = connected_components(edges)
    placed = points.join(member, points["point"] == member["node"], "left").select("point", F.coalesce("root", "point").alias("root"), "least")
    # Cut, so that the join deals both sides itself and a large component's rows can be split.
    roots = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")), "roots", rows)
    return cut(placed.join(roots, "root").select("point", "component_id"), "classes", rows)


def components(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = 4, radius: int = 4, parts: int = 1, bucket: int = BUCKET) -> DataFrame:
    """(key, fingerprint 16 hex digits, component_id) for each row of docs: fingerprints link at
    radius or fewer differing bits, and component_id is the smallest key that links reach.

    Null and empty texts have fingerprint zero and link like any other; repeated rows keep each its
    row; a null key is a component_id only where the component has no other; an empty table gives an
    empty result; other columns of docs play no part.
    """
    with scratch(docs.sparkSession):
        own = keep(cut(fingerprints(docs, text=text, key=key, size=size), "fingerprints"))
        hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
        own = own.select(key, hexed.alias("fingerprint"), F.unhex(hexed).alias("point"))
        points = own.groupBy("point").agg(F.min(key).alias("least"))
        classes = keep(_classes(points, links(points.select("point"), radius, parts=parts, bucket=bucket), own.count()))
    return own.join(classes, "point").select(key, "fingerprint", "component_id")


# -- near-duplicates by similarity ----------------------------------------------------------------


def far_bits(similarity: float) -> int:
    """The wide distance that no pair of this similarity or more exceeds but by DOUBT standard
    deviations. Large sets differ in arccos(2J/(1+J))/pi of the bits; small ones, of which a bit is a
    majority of few, in up to a quarter more (4 of 5 shingles: 0.1875)."""
    p = 1.25 * float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    bits = 64 * WIDE
    return min(bits, round(p * bits + DOUBT * (p * (1 - p) * bits) ** 0.5))


def _runs(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[tuple[tuple, np.ndarray, int]]:
    """Rows (numbers..., binary of width words), sorted by the numbers, in; for each run of two rows or
    more of the same numbers these, its words, and 0. A run of over most rows comes in pieces, each of
    which begins with the last row of the one before and has 1 for 0."""
    now, held, size, again = None, [], 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        last = b.num_columns - 1
        ids = np.stack([b.column(k).to_numpy() for k in range(last)])
        words = _point_array(b.column(last), width)
        bounds = np.r_[0, np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(0)) + 1, b.num_rows]
        # Runs of one row inside a batch are passed over; the first and the last may go on in another.
        for k in np.unique(np.r_[0, np.flatnonzero(np.diff(bounds) > 1), len(bounds) - 2]).tolist():
            lo, hi = int(bounds[k]), int(bounds[k + 1])
            key = tuple(ids[:, lo].tolist())
            if key != now:
                if size > 1:
                    yield now, np.concatenate(held), again
                now, held, size, again = key, [], 0, 0
            held.append(words[lo:hi])
            size += hi - lo
            while size > most:
                joined = np.concatenate(held)
                yield now, joined[:most], again
                held, size, again = [joined[most - 1 :]], size - most + 1, 1
    if size > 1:
        yield now, np.concatenate(held), again


def _word(k: int) -> Column:
    """The k-th word of a point as a long."""
    return F.conv(F.hex(F.substring("point", 8 * k + 1, 8)), 16, -10).cast("long")


def covered(points: DataFrame, radius: int) -> DataFrame:
    """(part, digest) of points: a row for each mask that covers the radius over the wide fingerprint.
    Two points within the radius share a part."""
    masks = covering_masks(radius, WIDE, 64 * WIDE)
    tables = [(n * WIDE // len(masks), m >> 64 * (n * WIDE // len(masks))) for n, m in enumerate(masks)]
    each = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(w).alias("w"), F.lit(signed(m)).alias("m")) for n, (w, m) in enumerate(tables)))
    words = points.select(_word(0).alias("digest"), F.array(*(_word(2 + k) for k in range(WIDE))).alias("words"))
    rows = words.select("digest", "words", F.explode(each).alias("x"))
    return rows.select(F.xxhash64("x.n", F.element_at("words", F.col("x.w") + 1).bitwiseAND(F.col("x.m"))).alias("part"), "digest")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (part, digest) sorted by part those whose part another row has too. The last row of a batch
    waits for the next one."""
    held, was = np.zeros((2, 0), np.int64), False
    for b in batches:
        if not b.num_rows:
            continue
        rows = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
        same = rows[0, 1:] == rows[0, :-1]
        more = np.r_[was, same] | np.r_[same, False]
        held, was = rows[:, -1:], bool(more[-1])
        if (some := rows[:, :-1][:, more[:-1]]).size:
            yield pa.RecordBatch.from_arrays([*map(pa.array, some)], names=["part", "digest"])
    if was:
        yield pa.RecordBatch.from_arrays([*map(pa.array, held)], names=["part", "digest"])


def _candidates(points: DataFrame, radius: int) -> DataFrame:
    """(part, point): the members of each bucket, of the covering masks and of the minima, that holds two
    points or more."""
    minima = points.select(F.explode("keys").alias("part"), _word(0).alias("digest"))
    dealt = covered(points, radius).unionByName(minima).repartition("part").sortWithinPartitions("part")
    members = cut(dealt.mapInArrow(_shared, "part bigint, digest bigint"), "shared")
    return members.join(points.select(_word(0).alias("digest"), "point"), "digest").select("part", "point")


def _cells(words: np.ndarray) -> list[bytes]:
    raw, step = words.astype(">u8").tobytes(), 8 * words.shape[1]
    return [raw[k : k + step] for k in range(0, len(raw), step)]


def _first_links(batches: Iterator[pa.RecordBatch], most: int, bucket: int) -> Iterator[pa.RecordBatch]:
    """Rows (part, point) sorted by bucket in, rows (a, b, part) out: edges of the minimum spanning
    forests by wide distance, with part null, and the members of buckets of two or more as (point,
    null, part). A bucket's pieces of bucket rows are spanned one by one."""
    a, b, parts = [], [], []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(parts, pa.int64())], names=["a", "b", "part"])
        for x in (a, b, parts):
            x.clear()
        return batch

    for (part,), words, again in _runs(batches, SET, bucket):
        edges = forest(np.c_[np.zeros(len(words), np.uint64), words[:, 2:]], 0, most)
        cells = _cells(words)
        a += [*(cells[x] for x, _, _ in edges), *cells[again:]]
        b += [*(cells[y] for _, y, _ in edges), *[None] * (len(cells) - again)]
        parts += [*[None] * len(edges), *[part] * (len(cells) - again)]
        if len(a) > 20_000:
            yield flush()
    yield flush()


def _other_links(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, i, k, share, point, root, shingles) sorted by the first three in, rows (a, b) out:
    links between points of different roots, one in share i and the other in share k of a bucket. The
    pairs are decided here, on the shingles themselves, and only links that unite two roots leave the
    task: with what united them before, they stand for all links of the block."""
    a: list[bytes] = []
    b: list[bytes] = []

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
        a.clear()
        b.clear()
        return batch

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    for (_, i, k), group in itertools.groupby(rows(), key=lambda r: r[:3]):
        held = list(group)
        if len({r[5] for r in held}) == 1:
            continue
        for x, y in _united([r[3] for r in held] if i != k else None, [r[5] for r in held], [np.frombuffer(r[6], np.uint32) for r in held], similarity):
            a.append(held[x][4])
            b.append(held[y][4])
        if len(a) > 20_000:
            yield flush()
    yield flush()


def _united(shares: list[int] | None, roots: list[bytes], sets: list[np.ndarray], similarity: float) -> Iterator[tuple[int, int]]:
    """(x, y): pairs of rows of different shares, if any are given, whose sets have the similarity and
    whose roots nothing has united so far. Every other such pair has roots that these pairs unite."""
    names: dict[bytes, int] = {}
    root = np.array([names.setdefault(r, len(names)) for r in roots])
    sizes = np.array([len(s) for s in sets], np.int64)
    share = np.array(shares if shares is not None else range(len(sets)))
    # By size, so that the partners a row's size allows follow it without a gap.
    order = np.argsort(sizes, kind="stable")
    root, sizes, share = root[order], sizes[order], share[order]
    words, ids = np.unique(np.concatenate([sets[x] for x in order]), return_inverse=True)
    starts = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(words), bool)
    for x in range(len(sets) - 1):
        end = int(np.searchsorted(sizes, sizes[x] / similarity + 1e-9, side="right"))
        if end <= x + 1:
            continue
        near = np.flatnonzero((root[x + 1 : end] != root[x]) & (share[x + 1 : end] != share[x])) + x + 1
        if not len(near):
            continue
        own = ids[starts[x] : starts[x + 1]]
        mark[own] = True
        for at in range(0, len(near), 256):
            some = near[at : at + 256]
            some = some[root[some] != root[x]]
            if not len(some):
                continue
            lo, hi = int(starts[some[0]]), int(starts[some[-1] + 1])
            sums = np.r_[0, np.cumsum(mark[ids[lo:hi]])]
            both = sums[starts[some + 1] - lo] - sums[starts[some] - lo]
            for y in some[both >= similarity * (sizes[some] + sizes[x] - both)].tolist():
                if root[y] != root[x]:
                    root[root == root[y]] = root[x]
                    yield int(order[x]), int(order[y])
        mark[own] = False


def _untried(members: DataFrame, near: DataFrame, sets: DataFrame, similarity: float, bucket: int) -> DataFrame:
    """Links (a, b) among all pairs of one bucket whose points near leaves in different components. A
    bucket of over half of bucket points, or of more than SHARE_BYTES of shingles, is dealt out by
    pairs of shares."""
    member = connected_components(near)
    placed = members.join(member, members["point"] == member["node"], "left").select("part", "point", F.coalesce("root", "point").alias("root"))
    placed = cut(placed, "placed")
    root = F.xxhash64("root")
    open_ = placed.join(placed.groupBy("part").agg(F.min(root).alias("lo"), F.max(root).alias("hi")).where("lo <> hi").select("part"), "part", "left_semi")
    held = cut(open_.join(sets, "point"), "open")
    shares = F.ceil(F.greatest(F.count(F.lit(1)) * 2 / bucket, F.sum(F.length("shingles")) * 2 / SHARE_BYTES)).cast("long")
    dealt = held.join(held.groupBy("part").agg(shares.alias("shares")), "part").withColumn("own", F.pmod(F.xxhash64("point"), F.col("shares")))
    dealt = dealt.select("part", "point", "root", "shingles", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("other"))
    dealt = dealt.select("part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("k"), "own", "point", "root", "shingles").repartition("part", "i", "k").sortWithinPartitions("part", "i", "k")
    return dealt.mapInArrow(lambda batches: _other_links(batches, similarity), "a binary, b binary")


def _shingle_sets(docs: DataFrame, text: str, key: str, wanted: DataFrame, size: int) -> DataFrame:
    """(point, shingles) of the points of wanted (key, point), each a row's with that key: sorted 32-bit
    hashes. Other texts under the same key are told by their digests."""
    few = wanted.count() <= SENT
    rows = docs.select(F.col(key).alias("_own"), text_of(docs[text]).alias("_t"))
    wanted = F.broadcast(wanted) if few else wanted
    rows = rows.join(wanted, rows["_own"].eqNullSafe(wanted["_k"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points, sets = [], []
            for point, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h, digest = set_of(t, size)
                if digest == int.from_bytes(point[:8], "big"):
                    points.append(point)
                    sets.append(np.unique(h.astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(points, pa.binary()), pa.array(sets, pa.binary())], names=["point", "shingles"])

    return cut(rows.select("point", "_t").mapInArrow(run, "point binary, shingles binary").dropDuplicates(["point"]), "sets")


def _jaccard(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) whose shingle sets have the similarity or more."""
    first, second = sets.toDF("a", "sa"), sets.toDF("b", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return edges.select("a", "b").join(first, "a").join(second, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", size: int = WORDS, similarity: float = SIMILARITY, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(key, component_id) for each row of docs: rows link whose sets of shingles of size words have the
    Jaccard similarity or more, among those whose wide fingerprints are within the radius or that share
    a key of minima. component_id is the smallest key that links reach. Rows without words are in no
    component and have their own key; nulls, repeats and empty tables as in components()."""
    with scratch(docs.sparkSession):
        own = keep(cut(set_points(docs, text=text, key=key, size=size), "points"))
        points = cut(own.where("point is not null").groupBy("point", "keys").agg(F.min(key).alias("least")), "distinct")
        most, count = far_bits(similarity), own.count()
        dealt = _candidates(points, radius).repartition("part").sortWithinPartitions("part")
        done = cut(dealt.mapInArrow(lambda batches: _first_links(batches, most, bucket), "a binary, b binary, part bigint"), "first")
        members = done.where("part is not null").select("part", F.col("a").alias("point"))
        edges = cut(done.where("part is null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
        wanted = cut(points.join(members.select("point").distinct(), "point").select(F.col("least").alias("_k"), "point"), "wanted")
        sets = _shingle_sets(docs, text, key, wanted, size)
        near = cut(_jaccard(edges, sets, similarity), "near")
        # Whatever the forests left open: after it each pair of a bucket is linked, refuted or in one component.
        near = near.unionByName(_untried(members, near, sets, similarity, bucket))
        classes = keep(_classes(points.select("point", "least"), near, count))
    return own.join(classes, "point", "left").select(key, F.coalesce("component_id", key).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id", **how) -> DataFrame:
    """The rows of docs that stay: of each component of near_duplicates() the row with the smallest
    key, with all columns. Rows that repeat that key stay with it."""
    gone = near_duplicates(docs, text=text, key=key, **how).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct()
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
