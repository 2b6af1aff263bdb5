"""Language-model scoring by context-tree weighting over bytes, beside a word-count base.

A byte is eight binary decisions, each with its own counts in every context. A context of depth d is
the last d bytes; every context node weighs its own Krichevsky-Trofimov estimate against the
product of what its extensions give, down to DEPTH bytes, so all depths mix by how well they coded the
training texts. The tree has every context that the texts hold, however many that are: it is a table,
dealt out by the three newest bytes, below which each part is weighed in one task. A part has at most
2^24 distinct runs by the alphabet, whatever the corpus. What lies above is one small table.

With counts and weights fixed, the code length of a byte depends on its run, DEPTH context bytes and
the byte itself, alone. So each distinct run is scored once. Workers hold the logarithms of the most
frequent runs, and the few places of a text that hold others are looked up by a join: which runs are
held decides the cost of a lookup and never the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import bounded_batches, crc_remainder, cut, keep, scratch, text_of

DEPTH = 5
#: Depth of the contexts that the tree is dealt out by.
DEALT = 3
#: Words whose counts and runs whose logarithms every worker holds; the others are looked up by a join.
FREQUENT, RUNS = 200_000, 1 << 20
#: Distinct words and runs a task holds before it hands them on, runs it weighs and places it scores at a time.
HELD, CHUNK, WINDOW = 400_000, 200_000, 1 << 21
#: Bytes that no UTF-8 text has: what ends a text, and what stands before its first byte.
END, BEFORE = 0xFF, 0xFE

_HALF = math.log(0.5)


def coded(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


def stream_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each with DEPTH bytes BEFORE ahead of it and its END behind; and how
    many symbols each text has, the end included."""
    gap = bytes([END]) + bytes([BEFORE]) * DEPTH
    data = np.frombuffer(gap[1:] + gap.join(texts) + gap[:1], np.uint8)
    return data, np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))


def runs_of(data: np.ndarray, window: int = WINDOW) -> Iterator[np.ndarray]:
    """The runs of a stream's symbols, window of its bytes at a time, as numbers: the newest context
    byte is the highest byte, the symbol the lowest, so the runs of a context are neighbours."""
    for at in range(0, max(0, len(data) - DEPTH), window):
        yield _runs_of_part(data[at : at + window + DEPTH])


def _runs_of_part(part: np.ndarray) -> np.ndarray:
    wide = part.astype(np.int64)
    n = len(part) - DEPTH
    code, shifted = wide[DEPTH:].copy(), np.empty(n, np.int64)
    for k in range(1, DEPTH + 1):
        np.left_shift(wide[DEPTH - k : DEPTH - k + n], 8 * (DEPTH + 1 - k), out=shifted)
        code |= shifted
    return code[part[DEPTH:] != BEFORE]


def run_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Each distinct run, sorted, and how often it occurs."""
    found = [np.unique(x, return_counts=True) for x in runs_of(stream_of(texts)[0])]
    return _summed(np.concatenate([x for x, _ in found]), np.concatenate([n for _, n in found])) if len(found) > 1 else found[0]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, where = np.unique(keys, return_inverse=True)
    return own, np.bincount(where, n, len(own)).astype(np.int64)


# -- weights --------------------------------------------------------------------------------------


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series after a shift by seven."""
    shift, y = np.ones_like(x), x.copy()
    for _ in range(7):
        shift *= y
        y = y + 1
    inv = 1 / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + inv / 12 - inv**3 / 360 + inv**5 / 1260 - np.log(shift)


_SMALL = 1 << 14
_TABLES = {x: log_gamma(np.arange(_SMALL) + x) for x in (0.5, 1.0)}


def _log_gamma_of(n: np.ndarray, plus: float) -> np.ndarray:
    out = _TABLES[plus][np.minimum(n, _SMALL - 1)]
    if len(large := np.flatnonzero(n >= _SMALL)):
        out[large] = log_gamma(n[large] + plus)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence of a zeros and b ones."""
    return _log_gamma_of(a, 0.5) + _log_gamma_of(b, 0.5) - _log_gamma_of(a + b, 1.0) - math.log(math.pi)


class Level:
    """The decision nodes of one depth and one bit. keys, sorted: context, then the bits decided before."""

    def __init__(self, keys: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray | None):
        """below: ln of the product of what extends the nodes; none at the deepest level."""
        self.keys, self.a, self.b = keys, a, b
        own = log_kt(a, b)
        self.whole = own if below is None else _HALF + np.logaddexp(own, below)
        self.weight = np.ones(len(keys)) if below is None else np.exp(np.minimum(0.0, _HALF + own - self.whole))

    def up(self, bits: int) -> np.ndarray:
        """The keys of the nodes that these extend; bits: how many of a key are bits decided before."""
        return self.keys >> (8 + bits) << bits | self.keys & ((1 << bits) - 1)


def weigh(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """codes: all runs, sorted, of whole contexts of depth DEALT; n: their counts. Gives, for each run
    and bit, the probability below depth DEALT - 1 of what the run's byte decides; and for each bit
    (bit, keys, a, b, below) of the nodes of depth DEALT - 1, as far as these runs tell."""
    depths = range(DEPTH, DEALT - 1, -1)
    rows: dict[int, tuple] = {}
    for d in depths:
        if d == DEPTH:
            rows[d] = codes, n, None
        else:
            keys, where = np.unique(codes >> (8 * (DEPTH + 1 - d)) << 8 | codes & 255, return_inverse=True)
            rows[d] = keys, np.bincount(where, n, len(keys)).astype(np.int64), where
    parts, tops = np.zeros((len(codes), 8), np.float32), []
    for bit in range(8):
        value = codes >> (7 - bit) & 1
        levels, places = {}, {}
        for d in depths:
            keys, count, where = rows[d]
            node = keys >> (8 - bit)
            starts = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1]
            ones = np.add.reduceat(count * (keys >> (7 - bit) & 1), starts)
            below = None
            if d < DEPTH:
                longer = levels[d + 1]
                below = np.bincount(np.searchsorted(node[starts], longer.up(bit)), longer.whole, len(starts))
            levels[d] = Level(node[starts], np.add.reduceat(count, starts) - ones, ones, below)
            place = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(node)]))
            places[d] = place if where is None else place[where]
        p = np.zeros(len(codes))
        for d in depths:
            level, at = levels[d], places[d]
            a, b, weight = level.a[at], level.b[at], level.weight[at]
            p = weight * (np.where(value, b, a) + 0.5) / (a + b + 1) + (1 - weight) * p
        parts[:, bit] = p
        last = levels[DEALT]
        keys, where = np.unique(last.up(bit), return_inverse=True)
        tops.append((bit, keys, *(np.bincount(where, x, len(keys)) for x in (last.a, last.b, last.whole))))
    return parts, tops


class Top:
    """The tree above depth DEALT: for each node of depth DEALT - 1 the probability that what is no
    deeper gives a one, and how much is left to what is deeper. At most 2^24 nodes by the alphabet."""

    def __init__(self, node: np.ndarray, a: np.ndarray, b: np.ndarray, below: np.ndarray):
        """node: context << 8 | 1 << bit | bits decided before."""
        order = np.argsort(node)
        levels = [Level(node[order], a[order].astype(np.int64), b[order].astype(np.int64), below[order])]
        wheres = []
        for _ in range(DEALT - 1):
            last = levels[-1]
            keys, where = np.unique(last.up(8), return_inverse=True)
            wheres.append(where)
            levels.append(Level(keys, *(np.bincount(where, x, len(keys)).astype(np.int64) for x in (last.a, last.b)), np.bincount(where, last.whole, len(keys))))
        got, left = np.zeros(len(levels[-1].keys)), np.ones(len(levels[-1].keys))
        for k in range(DEALT - 1, -1, -1):
            level = levels[k]
            if k < DEALT - 1:
                got, left = got[wheres[k]], left[wheres[k]]
            got = got + left * level.weight * (level.b + 0.5) / (level.a + level.b + 1)
            left = left * (1 - level.weight)
        self.keys, self.got, self.left = levels[0].keys.astype(np.int32), got, left

    def log10p(self, codes: np.ndarray, parts: np.ndarray) -> np.ndarray:
        """log10 of the probability of each run's byte after its context."""
        out = np.zeros(len(codes))
        context, symbol = codes >> (8 * (DEPTH + 2 - DEALT)) << 8, codes & 255
        for bit in range(8):
            at = np.searchsorted(self.keys, (context | 1 << bit | symbol >> (8 - bit)).astype(np.int32))
            got, left = self.got[at], self.left[at]
            out += np.log10(np.where(symbol >> (7 - bit) & 1, got, 1 - left - got) + left * parts[:, bit])
        return out


# -- the corpus -----------------------------------------------------------------------------------


def statistics(docs: DataFrame, text: Column, train: Column) -> DataFrame:
    """Over all rows: (word binary, run long, n): counts in the training rows of words, of ends (the
    empty word) and of runs, those of other rows with n = 0 too; combined within each task as far as
    memory allows and summed over all."""
    bounded_batches(docs.sparkSession)

    def tell(words: Counter, runs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        w = pa.array([*words.keys(), *[None] * len(runs)], pa.binary())
        g = pa.array(np.r_[np.zeros(len(words), np.int64), runs], mask=np.r_[np.ones(len(words), bool), np.zeros(len(runs), bool)])
        c = pa.array(np.r_[np.fromiter(words.values(), np.int64, len(words)), n])
        batch = pa.RecordBatch.from_arrays([w, g, c], names=["word", "run", "n"])
        for at in range(0, batch.num_rows, 100_000):
            yield batch.slice(at, 100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        runs, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: dict[bool, list[bytes]] = {True: [], False: []}
        size = 0

        def merge() -> None:
            nonlocal runs, n, size
            for learned, texts in waiting.items():
                if texts:
                    own, count = run_counts(texts)
                    runs, n = _summed(np.r_[runs, own], np.r_[n, count * learned])
                    texts.clear()
            size = 0

        for b in batches:
            for text, learned in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = coded(text)
                if learned:
                    words.update(t.split())
                    words[b""] += 1
                waiting[learned].append(t)
                size += len(t)
                if size > WINDOW:
                    merge()
            if len(words) > HELD:
                yield from tell(words, runs[:0], n[:0])
                words = Counter()
            if len(runs) > 4 * HELD:
                yield from tell(Counter(), runs, n)
                runs, n = runs[:0], n[:0]
        merge()
        yield from tell(words, runs, n)

    return docs.select(text.alias("_t"), train.alias("_train")).mapInArrow(run, "word binary, run bigint, n bigint")


def most_frequent(df: DataFrame, key: str, count: str, most: int) -> DataFrame:
    """most rows of df, or nearly as many, of those with the largest positive counts. Whole powers of
    2^(1/32) are taken while they fit; of the next, as many of 4096 hash shares as fit. So no task ranks
    all rows, and a table of equal counts fills its place too."""
    power, share = F.floor(F.log2(F.col(count)) * 32), F.pmod(F.xxhash64(key), F.lit(4096))
    df = df.where(F.col(count) > 0)
    total, least = 0, None
    for p, n in sorted(df.groupBy(power.alias("p")).count().collect(), reverse=True):
        if total + n > most:
            shares = sorted(df.where(power == p).groupBy(share.alias("s")).count().collect())
            kept = 0
            for s, m in shares:
                if total + m > most:
                    break
                total, kept = total + m, s + 1
            return df.where((power > p) | ((power == p) & (share < kept)))
        total, least = total + n, p
    return df if least is not None else df.limit(0)


def log_probabilities(runs: DataFrame) -> DataFrame:
    """(run, n, l): log10 of the probability of the last byte of each run. runs: (run, n), distinct."""
    bounded_batches(runs.sparkSession)

    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops: dict[int, list] = {bit: [] for bit in range(8)}
        held: list[tuple] = []
        size = 0

        def nodes() -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[], [], [], []]
            for bit, found in tops.items():
                if found:
                    keys, where = np.unique(np.concatenate([x[0] for x in found]), return_inverse=True)
                    prefix = (1 << bit) - 1
                    columns[0].append((keys >> bit << 8) | 1 << bit | keys & prefix)
                    for k in (1, 2, 3):
                        columns[k].append(np.bincount(where, np.concatenate([x[k] for x in found]), len(keys)))
                    found.clear()
            key, a, b, below = (np.concatenate(c) if c else np.zeros(0) for c in columns)
            return pa.RecordBatch.from_arrays([pa.array(key.astype(np.int64)), pa.nulls(len(key), pa.int64()), pa.nulls(len(key), pa.binary()), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(below.astype(np.float64))], names=names)

        names = ["run", "n", "parts", "a", "b", "below"]

        def weighed(codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            parts, found = weigh(codes, n)
            for bit, *rest in found:
                tops[bit].append(rest)
            raw = pa.Array.from_buffers(pa.binary(32), len(codes), [None, pa.py_buffer(np.ascontiguousarray(parts))]).cast(pa.binary())
            none = pa.nulls(len(codes), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n), raw, none, none, pa.nulls(len(codes), pa.float64())], names=names)

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            """What is held, up to the last context that may go on."""
            nonlocal held, size
            codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            context = codes >> (8 * (DEPTH + 1 - DEALT))
            end = len(codes) if last else int(np.searchsorted(context, context[-1]))
            if end:
                yield weighed(codes[:end], n[:end])
            held, size = ([(codes[end:], n[end:])], len(codes) - end) if end < len(codes) else ([], 0)

        waits = CHUNK
        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy()))
                size += b.num_rows
                if size > waits:
                    yield from whole(False)
                    waits = max(CHUNK, 2 * size)  # a context that goes on isn't looked through again and again
            if sum(len(x[0]) for x in tops[7]) > HELD:
                yield nodes()
        if held:
            yield from whole(True)
        yield nodes()

    dealt = runs.select("run", "n").repartition(F.shiftright("run", 8 * (DEPTH + 1 - DEALT))).sortWithinPartitions("run")
    found = cut(dealt.mapInArrow(deep, "run bigint, n bigint, parts binary, a bigint, b bigint, below double"), "weights")
    rows = found.where("parts is null").groupBy("run").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("below").alias("below")).toArrow()
    top = runs.sparkSession.sparkContext.broadcast(Top(*(rows.column(x).to_numpy() for x in ("run", "a", "b", "below"))))

    def logs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(-1, 8)
            l = top.value.log10p(b.column(0).to_numpy(), parts) if b.num_rows else np.zeros(0)  # noqa: E741
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(l)], names=["run", "n", "l"])

    return cut(found.where("parts is not null").select("run", "n", "parts").mapInArrow(logs, "run bigint, n bigint, l double"), "logs")


# -- scoring --------------------------------------------------------------------------------------


def scored(docs: DataFrame, train: Column | None = None, *, text: str = "text", key: str = "doc_id", frequent: int = FREQUENT, runs: int = RUNS) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score, bytes, bits_per_byte) for
    each row of docs. train: which rows to learn from; by default those whose crc32 of the key as
    text modulo 5 isn't 1. held_out marks the others.

    Texts are whole, with A-Z lower-cased; null counts as empty. Tokens are words between ASCII white
    space and one end. base_score sums log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens; score is
    the tree's log10 probability of the text's bytes and its end. Null keys count as empty text and
    repeated rows are scored each; without training rows all counts are zero and every decision of
    the tree has probability one half; an empty table gives an empty result. frequent, runs: how many
    words and runs the workers hold, which the scores do not depend on.
    """
    spark = docs.sparkSession
    train = F.coalesce(crc_remainder(docs[key]) != 1 if train is None else train, F.lit(False))
    rows = docs.select(F.monotonically_increasing_id().alias("_id"), F.col(key).alias("_k"), text_of(docs[text]).alias("_t"), train.alias("_train"))
    with scratch(spark):
        counted = cut(statistics(rows, F.col("_t"), F.col("_train")), "statistics")
        words = keep(cut(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words"))
        logs = keep(log_probabilities(counted.where("run is not null").groupBy("run").agg(F.sum("n").alias("n"))))
    distinct, tokens = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    floor = math.log10(tokens + 0.5 * (distinct + 1))
    held = most_frequent(logs, "run", "n", runs).select("run", "l").toArrow()
    top = most_frequent(words, "word", "c", frequent).toArrow()
    known = {w: math.log10(c + 0.5) - floor for w, c in zip(top.column("word").to_pylist(), top.column("c").to_pylist(), strict=True)}
    shared = spark.sparkContext.broadcast((held.column("run").to_numpy(), held.column("l").to_numpy().astype(np.float32)))
    common = spark.sparkContext.broadcast(known)
    bounded_batches(spark)

    kind = docs.schema[key].dataType.simpleString()
    schema = f"_id bigint, _k {kind}, _train boolean, n_tokens bigint, met bigint, base double, score double, bytes bigint, word binary, run bigint, n bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_runs, known_logs = shared.value
        known_runs = pa.array(known_runs)
        logs = common.value
        whole = len(logs) == distinct  # no word is anywhere else
        names = [x.split()[0] for x in schema.split(", ")]

        def rest(like: pa.RecordBatch, ids: list, word: list | None, run: np.ndarray | None, n: list | np.ndarray) -> pa.RecordBatch:
            """Rows of words or runs that have to be looked up."""
            none = lambda t: pa.nulls(len(ids), t)
            numbers = none(pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), none(like.schema.field(1).type), none(pa.bool_()), numbers, numbers, none(pa.float64()), none(pa.float64()), numbers]
                + [none(pa.binary()) if word is None else pa.array(word, pa.binary()), numbers if run is None else pa.array(run, pa.int64()), pa.array(n, pa.int64())],
                names=names,
            )

        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            texts = [coded(t) for t in b.column(2).to_pylist()]
            n, hit, base = [], [], []
            far: tuple[list, list, list] = ([], [], [])
            for k, t in enumerate(texts):
                own = t.split()
                own.append(b"")
                n.append(len(own))
                total, met = 0.0, 0
                for w, times in Counter(own).items():
                    if (x := logs.get(w)) is not None:
                        total += times * x
                        met += times
                    elif whole:
                        total += times * (math.log10(0.5) - floor)
                    else:
                        for column, value in zip(far, (int(ids[k]), w, times), strict=True):
                            column.append(value)
                hit.append(met)
                base.append(total)
                if len(far[0]) > 50_000:
                    yield rest(b, far[0], far[1], None, far[2])
                    far = ([], [], [])
            if far[0]:
                yield rest(b, far[0], far[1], None, far[2])
            data, sizes = stream_of(texts)
            ends = np.cumsum(sizes)
            score = np.zeros(len(texts))
            done = 0
            for codes in runs_of(data, WINDOW):
                if not len(codes):  # all of it lies between two texts
                    continue
                at = pc.index_in(pa.array(codes), value_set=known_runs)
                missing = np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False)) if at.null_count else np.zeros(0, np.int64)
                value = known_logs[at.fill_null(0).to_numpy()] if len(known_logs) else np.zeros(len(codes), np.float32)
                value[missing] = 0.0
                first, last = np.searchsorted(ends, (done, done + len(codes) - 1), side="right")
                score[first : last + 1] += np.add.reduceat(value, np.maximum(ends[first : last + 1] - sizes[first : last + 1] - done, 0), dtype=np.float64)
                for lo in range(0, len(missing), 50_000):
                    some = missing[lo : lo + 50_000]
                    yield rest(b, ids[np.searchsorted(ends, done + some, side="right")].tolist(), None, codes[some], np.ones(len(some), np.int64))
                done += len(codes)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(3), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(base, pa.float64()), pa.array(score), pa.array([len(t) for t in texts], pa.int64())]
                + [pa.nulls(len(texts), x) for x in (pa.binary(), pa.int64(), pa.int64())],
                names=names,
            )

    local = cut(rows.mapInArrow(run, schema), "local")
    c = F.coalesce("c", F.lit(0))
    by_word = local.where("word is not null").select("_id", "word", "n").join(words, "word", "left").select("_id", F.when(c > 0, F.col("n")).otherwise(0).alias("met2"), (F.col("n") * (F.log10(c + 0.5) - F.lit(floor))).alias("base2"), F.lit(0.0).alias("score2"))
    by_run = local.where("run is not null").select("_id", "run").join(logs.select("run", "l"), "run").select("_id", F.lit(0).cast("long").alias("met2"), F.lit(0.0).alias("base2"), F.col("l").alias("score2"))
    more = by_word.unionByName(by_run).groupBy("_id").agg(*(F.sum(x).alias(x) for x in ("met2", "base2", "score2")))
    out = local.where("bytes is not null").drop("word", "run", "n").join(more, "_id", "left")
    total = lambda x, y: F.col(x) + F.coalesce(y, F.lit(0.0))
    score = total("score", "score2")
    return out.select(
        F.col("_k").alias(key), (~F.col("_train")).alias("held_out"), "n_tokens", (F.col("met") + F.coalesce("met2", F.lit(0))).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        total("base", "base2").alias("base_score"), score.alias("score"), "bytes", (-score / (F.col("bytes") + 1) * math.log2(10)).alias("bits_per_byte"),
    )
