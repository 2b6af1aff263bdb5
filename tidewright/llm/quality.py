"""A supervised classifier over hashed subword embeddings, trained by stochastic gradient descent.

Words and the character n-grams of a text hash into BUCKETS vectors that are learned; a document is
the mean of its vectors, and a softmax layer gives the two classes. Since the layer is linear, a
trained model scores a text as the mean of one number per n-gram, so scoring is a table look-up.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidewright.llm.common import bounded_batches, crc_remainder, text_of, with_text

BITS = 18
BUCKETS = 1 << BITS
#: Byte n-grams beside whole words.
GRAMS = (2, 3, 4, 5)
#: Labelled rows of each class that the fit reads at most, and bytes of text of each class: the bound of
#: the training sample. Texts are taken whole, in the order of their keys' hashes.
SAMPLE, SAMPLE_BYTES = 2000, 16 << 20
DIM, EPOCHS, RATE, SEED = 8, 8, 0.5, 7
#: Bytes that one scoring step hashes at a time.
STEP = 1 << 20

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SPACES = np.zeros(256, bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True


def features(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all words and byte n-grams of the whole text, A-Z lower-cased, in pieces
    that overlap so that none is left out or counted twice."""
    data = np.frombuffer(b" " + text.encode("utf-8", "surrogatepass").lower() + b" ", np.uint8)
    for at in range(0, max(1, len(data)), STEP):
        part = data[at : at + STEP + max(GRAMS) - 1]
        own = min(STEP, len(data) - at)  # n-grams that start here
        wide = part.astype(np.uint64)
        roll = np.zeros(len(part), np.uint64)
        for n in range(1, max(GRAMS) + 1):
            m = len(part) - n + 1
            if m <= 0:
                break
            roll = roll[:m] * np.uint64(0x100000001B3) + wide[n - 1 : n - 1 + m]
            if n in GRAMS:
                h = (roll[: min(own, m)] + np.uint64(n)) * _MIX
                yield (h >> np.uint64(64 - BITS)).astype(np.int32)
    yield word_buckets(data)


def word_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket numbers of the words and the pairs of neighbouring words of a text, by a polynomial
    hash of their bytes."""
    space = _SPACES[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(starts):
        return np.zeros(0, np.int32)
    powers = np.cumprod(np.full(4096, 0x100000001B3, np.uint64))
    pos = np.arange(len(data)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(data)]))
    value = np.where(space, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * powers[pos & 4095])
    h = np.add.reduceat(value, starts)
    # A pair of neighbours hashes by its difference: all immediate repeats share one learned vector.
    both = np.concatenate([h * _MIX, (h[1:] - h[:-1] + np.uint64(1)) * _MIX])
    return (both >> np.uint64(64 - BITS)).astype(np.int32)


@dataclasses.dataclass
class Model:
    """gain[b]: what bucket b adds to the log-odds of label 1, averaged over a text; bias."""

    gain: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        """Probability of label 1. A text without words scores by the bias alone."""
        total, n = 0.0, 0
        if text and not text.isspace():
            for f in features(text):
                total += float(self.gain[f].sum(dtype=np.float64))
                n += len(f)
        z = self.bias + (total / n if n else 0.0)
        return 1.0 / (1.0 + float(np.exp(-np.clip(z, -60, 60))))


def fit(texts: list[str], labels: list[int], prior: float | None = None) -> Model:
    """Trains on texts with labels 0 or 1. prior: the share of label 1 where the sample was drawn
    from; the sample may be balanced. Without both labels, the model scores the prior."""
    y = np.array(labels, np.int64)
    share = float(y.mean()) if len(y) else 0.5
    prior = share if prior is None else prior
    odds = float(np.log(np.clip(prior, 1e-6, 1 - 1e-6) / (1 - np.clip(prior, 1e-6, 1 - 1e-6))))
    if not len(y) or share in (0.0, 1.0):
        return Model(np.zeros(BUCKETS, np.float32), odds)
    rng = np.random.default_rng(SEED)
    vectors = ((rng.random((BUCKETS, DIM), dtype=np.float32) - 0.5) / DIM).astype(np.float32)
    layer = np.zeros((DIM, 2), np.float32)
    offset = np.zeros(2, np.float32)
    rows = []
    for t in texts:
        ids, counts = np.unique(np.concatenate(list(features(t))), return_counts=True)
        rows.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    steps, done = EPOCHS * len(y), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(y)):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, part = rows[k]
            own = vectors[ids]
            hidden = part @ own
            z = hidden @ layer + offset
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[k]] -= 1
            p *= weight[k] * rate
            back = layer @ p
            layer -= np.outer(hidden, p)
            offset -= p
            # Each vector's share of the mean is small; the step is scaled so that rare and frequent ones learn alike.
            vectors[ids] = own - np.outer(np.minimum(1.0, part * 50), back)
    gain = (vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32)
    return Model(gain, float(offset[1] - offset[0]) + odds)


def training_sample(docs: DataFrame, labels: DataFrame, *, text: str, key: str, label: str, sample: int, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int], float]:
    """Texts, labels and the share of label 1. Of the labelled rows outside the held-out fifth, each
    class gives those whose keys have the smallest hashes, sample rows and sample_bytes at most; the
    first that goes beyond the bytes and what follows it are left out. Null keys and labels other than
    0 and 1 are left out; a key with several labels has the smallest, with several texts the largest."""
    own = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).where(F.col("_k").isNotNull() & F.col("_y").isin(0, 1))
    own = own.where(crc_remainder(F.col("_k")) != 0).groupBy("_k").agg(F.min("_y").alias("_y"))
    n = dict(own.groupBy("_y").count().collect())
    parts = [own.where(F.col("_y") == y).orderBy(F.xxhash64("_k"), "_k").limit(sample) for y in (0, 1)]
    chosen = parts[0].unionByName(parts[1])  # 2 x sample keys: small enough to broadcast by its bound
    rows = docs.select(F.col(key).alias("_k"), text_of(docs[text]).alias("_t")).join(F.broadcast(chosen), "_k")
    one = rows.groupBy("_k").agg(F.max("_t").alias("_t"), F.max("_y").alias("_y"))
    so_far = W.partitionBy("_y").orderBy(F.xxhash64("_k"), "_k").rowsBetween(W.unboundedPreceding, 0)  # 2 x sample rows
    one = one.withColumn("_b", F.sum(F.octet_length("_t").cast("long")).over(so_far)).where(F.col("_b") <= sample_bytes)
    found = sorted(one.select("_k", "_t", "_y").collect(), key=lambda r: (r["_y"], str(r["_k"])))
    return [r["_t"] for r in found], [r["_y"] for r in found], n.get(1, 0) / max(1, sum(n.values()))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of labels.label. It learns from texts alone, and only from rows whose crc32 of the key
    as text isn't divisible by five. An empty labels table gives a model that scores every text 0.5."""
    texts, marks, prior = training_sample(docs, labels, text=text, key=key, label=label, sample=sample)
    return fit(texts, marks, prior if texts else None)


def score(docs: DataFrame, model: Model, *, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """docs with score (double, 0 to 1) and predicted (int, 1 if score >= threshold). Null texts count
    as empty; empty texts score by the model's prior. Columns named so before are replaced."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS floats, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            scores = np.array([own.score(t) for t in b.column(b.num_columns - 1).to_pylist()], np.float64)
            more = [pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=[*b.schema.names[:-1], "score", "predicted"])

    rows, types = with_text(docs, text, ("score", "predicted"))
    return rows.mapInArrow(run, ", ".join([*types, "score double", "predicted int"]))
