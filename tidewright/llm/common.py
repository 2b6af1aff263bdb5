"""Helpers that the training-data operators share: shared-storage cuts and Arrow plumbing."""

from __future__ import annotations

import atexit
import contextlib
import logging
import os
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

logger = logging.getLogger(__name__)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows and bytes of an Arrow batch: long documents must not add up to gigabytes in a worker.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else, as byte-wise tools do. On texts of ASCII alone lower() does
    just that, and faster."""
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, UPPER, LOWER))


def text_of(col: str | Column) -> Column:
    """A text column in which null counts as the empty text."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what one Arrow batch carries to a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(columns: list[str], name: str) -> str:
    """name, or a longer one if a column is named so."""
    while name in columns:
        name += "_"
    return name


def with_text(docs: DataFrame, text: str, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """docs without the columns that an operator replaces and with the text, null as empty, as a last
    column beside them; and the types of what is kept, for a schema."""
    kept = [f for f in docs.schema if f.name not in replaced]
    own = text_of(docs[text]).alias(fresh(docs.columns, "_text"))
    return docs.select(*(docs[f"`{f.name}`"] for f in kept), own), [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset
    and the session is a local one (tests), a folder of this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


#: Narrow rows that one file of a table takes, where their number is known ahead.
FILE_ROWS = 200_000


#: Tables of the scratch scopes that are open, the innermost last; folders to remove when the driver ends.
_SCOPES: list[list[str]] = []
_FOLDERS: set[str] = set()


def cut(df: DataFrame, name: str = "t", rows: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again. The lineage ends there,
    and a lost executor costs a re-read instead of a recomputation. rows: how many there are at most,
    so that a small table isn't spread over as many files as the session has shuffle partitions.

    The table goes when the scratch scope it was made in ends, unless keep() hands it on, and with the
    application's folder when the driver ends."""
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    folder = f"{shared_dir(spark)}/tidewright-{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _SCOPES:
        _SCOPES[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def _remove(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except (Py4JError, OSError) as e:  # the JVM may be gone before the driver's last step
        logger.warning("%s stays: %s", path, e)


def drop_cut(df: DataFrame) -> None:
    """Removes a table that cut() wrote and nothing reads any more."""
    path = getattr(df, "_cut_path", None)
    if path:
        _remove(df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration(), path)
        for scope in _SCOPES:
            if path in scope:
                scope.remove(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are cut inside are removed at its end, but for those that keep() names."""
    scope: list[str] = []
    _SCOPES.append(scope)
    try:
        yield
    finally:
        _SCOPES.remove(scope)
        for path in scope:
            _remove(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def keep(df: DataFrame) -> DataFrame:
    """df, a table that cut() made, now belongs to the scope around the innermost one."""
    path = df._cut_path
    if _SCOPES and path in _SCOPES[-1]:
        _SCOPES[-1].remove(path)
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)
    return df


def crc_remainder(doc_id: Column, mod: int = 5) -> Column:
    """crc32 of doc_id as text, modulo mod; a null doc_id counts as the empty text (remainder 0)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
