"""Writing results: every table passes disclosure control, every run leaves a manifest."""

from __future__ import annotations

import dataclasses
import datetime
import hashlib
import json
import os
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators.disclosure import apply_policy, assert_publishable, policy_for

MANIFEST = "manifest.json"


@dataclasses.dataclass
class Writer:
    """The outputs of one arm. Tables are stamped with the model's name, withheld where small, checked
    and written; what is about single people is written only if asked for, and named if not."""

    arm: str
    directory: str
    model: str
    min_cell: int
    individual: bool = False
    figures: bool = True
    written: list[str] = dataclasses.field(default_factory=list)
    withheld: list[str] = dataclasses.field(default_factory=list)

    @property
    def path(self) -> str:
        return os.path.join(self.directory, self.arm)

    def suppressed(self, name: str, df: DataFrame) -> DataFrame:
        return apply_policy(name, df, self.min_cell)

    def withhold(self, name: str) -> None:
        if name not in self.withheld:
            self.withheld.append(name)

    def table(self, name: str, df: DataFrame, individual: bool = False) -> str | None:
        """Writes <arm>/<name>.parquet. Published tables are aggregates and small: one file each, but for
        tables about people. What must not be shown raises before anything is on disk."""
        if individual and not self.individual:
            self.withhold(name)
            return None
        out = self.suppressed(name, df)
        if "model" not in out.columns:
            out = out.select(F.lit(self.model).alias("model"), *out.columns)
        path = os.path.join(self.path, f"{name}.parquet")
        governed = policy_for(name) is not None
        out = out.persist(StorageLevel.MEMORY_AND_DISK) if governed else out  # checked and written from one computation
        try:
            assert_publishable(name, out, self.min_cell)
            (out if individual else out.coalesce(1)).write.mode("overwrite").parquet(path)
        finally:
            if governed:
                out.unpersist()
        self.written.append(os.path.relpath(path, self.directory))
        return path

    def figure(self, name: str, draw: Callable[[], str], individual: bool = False) -> str | None:
        """Writes <arm>/<name>.svg from what draw returns, unless figures are off or it is withheld."""
        if individual and not self.individual:
            self.withhold(name)
            return None
        if not self.figures or not (svg := draw()):
            return None
        os.makedirs(self.path, exist_ok=True)
        path = os.path.join(self.path, f"{name}.svg")
        with open(path, "w") as f:
            f.write(svg)
        self.written.append(os.path.relpath(path, self.directory))
        return path


#: Inputs up to so many bytes are told by a digest of their bytes, made in tasks; larger ones by the names,
#: sizes and checksums or dates that the file system has of their files.
WHOLE = 256 << 20


def _files(spark: SparkSession, path: str) -> list[tuple[str, int, str]]:
    """(path below, bytes, checksum or date of change) of the files of an input in any store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    out, found = [], fs.listFiles(root, True)
    base = fs.makeQualified(root).toString()
    while found.hasNext():
        f = found.next()
        name = f.getPath().toString().removeprefix(base).lstrip("/")
        if not f.getPath().getName().startswith(("_", ".")):
            sum_ = fs.getFileChecksum(f.getPath())
            out.append((name, f.getLen(), sum_.toString() if sum_ is not None else str(f.getModificationTime())))
    return sorted(out)


def input_record(spark: SparkSession, path: str) -> dict:
    """Files, bytes, rows and a digest of an input. The driver reads none of it: rows come from a count
    that file footers answer, and digests of files from tasks or from the file system."""
    files = _files(spark, path)
    if not files:
        return {"path": path, "files": 0, "bytes": 0, "sha256": None, "digest_of": None, "rows": None}
    size = sum(n for _, n, _ in files)
    if size <= WHOLE:
        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.sha2("content", 256).alias("x"))
        parts, of = sorted(r["x"] for r in content.collect()), "bytes"
    else:
        parts, of = [f"{name} {n} {mark}" for name, n, mark in files], "files"
    rows = spark.read.parquet(path).count() if any(name.endswith(".parquet") for name, _, _ in files) or path.endswith(".parquet") else None
    return {"path": path, "files": len(files), "bytes": size, "sha256": hashlib.sha256("\n".join(parts).encode()).hexdigest(), "digest_of": of, "rows": rows}


def manifest(spark: SparkSession, config, arms: list[dict], windows: list[dict], population: dict, warnings: list[str]) -> dict:
    """What ran on what, with what result. All but created and duration_s follow from the inputs."""
    data = {k: input_record(spark, p) for k in ("observed", "generated", "persons", "event_definitions") if (p := getattr(config.data, k))}
    return {
        "created": datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds"), "model": config.model.name, "config_hash": config.hash(), "config": config.model_dump(mode="json"), "inputs": data,
        "coverage": {"windows": windows, "population": population}, "arms": arms, "warnings": warnings, "individual_level": config.output.individual_level, "min_cell": config.output.min_cell,
    }


def write_manifest(directory: str, content: dict) -> None:
    os.makedirs(directory, exist_ok=True)
    with open(os.path.join(directory, MANIFEST), "w") as f:
        json.dump(content, f, indent=1, sort_keys=True, default=str)


def read_manifest(directory: str) -> dict:
    with open(os.path.join(directory, MANIFEST)) as f:
        return json.load(f)
