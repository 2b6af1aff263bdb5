"""Exact dedup by skew-safe combining, in DataFrame operations only.

Digests are counted first, on narrow rows. Those that occur more than once set a bit each in a bitmap
of fixed size, which all tasks get; a row whose bit is not set has no copy, and its text never leaves
its task. The others meet in three steps, none of which gathers a group: each task combines its own
copies before anything is dealt out, salted digest groups merge what the tasks found, and the salt
winners merge globally. Every step groups by the whole text beside its digest, so equal digests never
stand for equal texts. At last each row finds its group by digest; a digest that covers several
texts is told apart by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import ascii_lower, cut, fresh, text_of

#: Parts that a group of copies is dealt to before the global merge. A task has one salt, so of a group
#: it hands on one row.
SALTS = 16
#: Bits of the bitmap, in words of 64: at most 2^20 words of 16 bytes are sent to a task. Where texts with
#: copies outgrow it, more single texts pass as possible copies, which costs their shuffle and nothing else.
BITS = 26


def _normal(text: str | Column) -> Column:
    return ascii_lower(text_of(text))


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _bit(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(1 << BITS))


def _marks(digests: DataFrame) -> DataFrame:
    """(_w, _b): the words of the bitmap that have a bit of a digest _d that occurs more than once."""
    repeated = digests.groupBy("_d").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select(_bit("_d").alias("_h"))
    return cut(repeated.select(F.shiftright("_h", 6).alias("_w"), F.expr("shiftleft(1L, cast(_h & 63 as int))").alias("_b")).groupBy("_w").agg(F.bit_or("_b").alias("_b")), "marks")


def _marked(rows: DataFrame, marks: DataFrame, digest: str, name: str) -> DataFrame:
    """rows with a column of that name: whether the bit of its digest is set."""
    at, word, bits = (fresh([*rows.columns, name], x) for x in ("_h_", "_w_", "_b_"))
    words = F.broadcast(marks.toDF(word, bits))  # 2^(BITS - 6) rows of two longs at most
    own = rows.withColumn(at, _bit(digest)).join(words, F.shiftright(at, 6) == F.col(word), "left")
    return own.withColumn(name, F.coalesce(F.expr(f"shiftright({bits}, cast({at} & 63 as int)) & 1L") == 1, F.lit(False))).drop(at, word, bits)


def _combined(rows: DataFrame, marks: DataFrame, salts: int) -> DataFrame:
    """(_d, _t, _m, _n): of each text that has copies, and of single texts whose bit is set, the largest
    key and the number of rows. rows: (_k, _t, _d)."""
    maybe = _marked(rows, marks, "_d", "_maybe").where("_maybe").select("_k", "_t", "_d", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("_s"))
    salted = maybe.groupBy("_d", "_s", "_t").agg(F.max("_k").alias("_m"), F.count(F.lit(1)).alias("_n"))
    return salted.groupBy("_d", "_t").agg(F.max("_m").alias("_m"), F.sum("_n").alias("_n"))


def exact_groups(docs: DataFrame, *, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """One row per row of docs: (key, digest binary, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. The row
    with the largest key stays; a null key is smaller than any other. Rows that repeat key and text
    count in group_size, and each of them is marked kept if its key is the winner's. An empty table
    gives an empty result; other columns of docs play no part, whatever their names.
    """
    rows = docs.select(F.col(key).alias("_k"), _normal(docs[text]).alias("_t")).withColumn("_d", _digest(F.col("_t")))
    ids = cut(rows.select("_k", "_d"), "digests")
    groups = _combined(rows, _marks(ids), salts)
    found = cut(groups.groupBy("_d").agg(F.count(F.lit(1)).alias("_texts"), F.max("_m").alias("_m"), F.max("_n").alias("_n")), "groups")
    clash = found.where("_texts > 1").select("_d")
    if clash.isEmpty():
        out = ids.join(found, "_d", "left")
    else:
        torn = rows.join(clash, "_d", "left_semi").join(groups, ["_d", "_t"], "left").select("_k", "_d", "_m", "_n")
        out = ids.join(clash, "_d", "left_anti").join(found.drop("_texts"), "_d", "left").select("_k", "_d", "_m", "_n").unionByName(torn)
    keep = F.when(F.col("_n").isNull(), F.col("_k")).otherwise(F.col("_m"))
    return out.select(
        F.col("_k").alias(key), F.col("_d").alias("digest"), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_k").eqNullSafe(keep).alias("kept"), F.lower(F.hex("_d")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, *, text: str = "text", key: str = "doc_id", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of equal texts the row with
    the largest key. Rows that repeat the winning key and text collapse to one; of these, any may
    stay where other columns differ. Nulls and empty tables as in exact_groups(). Rows whose text has
    no copy stay where they are; the others meet the winners by text digest and key, so a hot group's
    rows are dealt by their keys."""
    rows = docs.select(F.col(key).alias("_k"), _normal(docs[text]).alias("_t")).withColumn("_d", _digest(F.col("_t")))
    marks = _marks(rows.select("_d"))
    tag = lambda k: F.coalesce(F.concat(F.lit("+"), F.col(k).cast("string")), F.lit(""))
    won = cut(_combined(rows, marks, salts).select("_d", F.xxhash64("_t").alias("_x"), tag("_m").alias("_g")), "winners")
    names = [fresh(docs.columns, x) for x in ("_dig", "_sum", "_tag")]
    normal, maybe = fresh(docs.columns, "_norm"), fresh(docs.columns, "_maybe")
    own = docs.withColumn(normal, _normal(docs[text])).withColumns({names[0]: _digest(F.col(normal)), names[1]: F.xxhash64(normal), names[2]: tag(key)}).drop(normal)
    own = _marked(own, marks, names[0], maybe)
    meet = own.where(maybe).join(won.toDF(*names), names, "left_semi").dropDuplicates(names)
    return own.where(~F.col(maybe)).unionByName(meet).select(*docs.columns)
