"""Several tables that change together: each set goes to a folder of its own, and one small file says which set holds."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

_MANIFESTS = "_manifests"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), lambda *parts: spark._jvm.org.apache.hadoop.fs.Path("/".join([folder.rstrip("/"), *parts]))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _files(spark, folder)
    if not fs.exists(at(_MANIFESTS)):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at(_MANIFESTS)) if f.getPath().getName().isdigit())


def published(spark: SparkSession, folder: str) -> dict[str, str]:
    """name -> path of the tables of the newest set; empty before the first."""
    numbers = _numbers(spark, folder)
    if not numbers:
        return {}
    _, at = _files(spark, folder)
    (row,) = spark.read.text(at(_MANIFESTS, str(numbers[-1])).toString(), wholetext=True).collect()
    return {name: f"{folder.rstrip('/')}/{path}" for name, path in json.loads(row.value).items()}


def publish(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Writes the tables as a new set and makes it the one that published() finds: all of them, or, if anything fails, none.

    The set holds from the moment that its manifest has been renamed to the next number, which fails if another writer took that number; tables that
    a set doesn't name keep their last version. Older sets stay until drop_old().
    """
    spark = next(iter(tables.values())).sparkSession
    fs, at = _files(spark, folder)
    before = published(spark, folder)
    number = max(_numbers(spark, folder), default=0) + 1
    version = f"set-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(at(version, name).toString())
    prefix = folder.rstrip("/") + "/"
    named = {name: path.removeprefix(prefix) for name, path in before.items()} | {name: f"{version}/{name}" for name in tables}
    fs.mkdirs(at(_MANIFESTS))
    draft = at(_MANIFESTS, f".{version}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(named), "utf-8"))
    out.close()
    if fs.exists(at(_MANIFESTS, str(number))) or not fs.rename(draft, at(_MANIFESTS, str(number))):
        fs.delete(draft, False)
        raise RuntimeError(f"another writer has published set {number} of {folder}")
    return published(spark, folder)


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Deletes manifests but the newest `keep`, and the sets that these don't name: only once no reader is at an older one."""
    fs, at = _files(spark, folder)
    numbers = _numbers(spark, folder)[-keep:]
    kept = set()
    for n in numbers:
        (row,) = spark.read.text(at(_MANIFESTS, str(n)).toString(), wholetext=True).collect()
        kept |= {path.split("/")[0] for path in json.loads(row.value).values()}
    for f in fs.listStatus(at()):
        name = f.getPath().getName()
        if name.startswith("set-") and name not in kept:
            fs.delete(f.getPath(), True)
    for n in _numbers(spark, folder):
        if n not in numbers:
            fs.delete(at(_MANIFESTS, str(n)), False)
