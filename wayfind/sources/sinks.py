"""Writers. `publish` adds versions that readers see in one step; `replace_table` puts a folder in the place of the old one."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own_folder: list[str] = []


def keep(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the folder of spark.checkpoint.dir and read back: computed once, and whole if executors are lost.

    Where that setting is unset, a temporary folder serves if all runs on this machine, as in tests; elsewhere that is an error.
    """
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="wayfind-kept-"))
            atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
        shared = _own_folder[0]
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, name: str, most: int = 100_000) -> DataFrame:
    """df, kept, and marked for the joins it goes into: sent to all tasks if it has at most `most` rows, else merged.

    Spark judges a table by its files, which say little of what it becomes once it is unpacked and exploded; with the mark the other
    side, whatever its files say, is never gathered."""
    kept = keep(df, name)
    return F.broadcast(kept) if kept.limit(most + 1).count() <= most else kept.hint("merge")


def replace_table(df: DataFrame, path: str) -> None:
    """Write beside path, then put the new folder in the place of the old one.

    The old rows stay until the new ones are whole, so df may read from path. Between the two renames there is no table at
    path; if the second fails, the old one is put back and an error is raised. What a failure leaves beside path has
    `.new-` in its name.
    """
    spark: SparkSession = df.sparkSession
    jvm = spark.sparkContext._jvm
    tag = uuid.uuid4().hex
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    target, fresh, old = at(path), at(f"{path}.new-{tag}"), at(f"{path}.old-{tag}")
    df.write.parquet(f"{path}.new-{tag}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def rename(a, b) -> bool:  # stores tell of a failure by false or by an exception
        try:
            return fs.rename(a, b)
        except (Py4JError, PySparkException):
            return False

    had = fs.exists(target)
    if had and not rename(target, old):
        raise OSError(f"{path} could not be moved aside; it is as it was")
    if not rename(fresh, target):
        if had and not rename(old, target):
            raise OSError(f"{path} could not be replaced; its rows are at {path}.old-{tag}")
        raise OSError(f"{path} could not be replaced; it is as it was")
    if had:
        fs.delete(old, True)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[str]:
    """The names of what was published at path, oldest first."""
    fs, at = _files(spark, f"{path}/_versions")
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def publish(tables: DataFrame | dict[str, DataFrame], path: str) -> str:
    """Write a table, or several that belong together, as a new version at path; returns its name.

    All rows are written to a folder of their own first. Then one empty file is made whose name says number and folder:
    from that moment readers see the new version, all its tables at once, and until then the old one. Nothing that a
    reader may hold is renamed or deleted, so there is no moment without a table, and what fails midway changes nothing. A
    version may be made from the one before. Of two writers at once the one of the greater name is seen.
    """
    frames = tables if isinstance(tables, dict) else {"": tables}
    if not frames:
        raise ValueError("nothing to publish")
    spark = next(iter(frames.values())).sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    for name, df in frames.items():
        df.write.parquet(f"{path}/{folder}/{name}".rstrip("/"))
    last = versions(spark, path)
    marker = f"{int(last[-1].split('.')[0]) + 1 if last else 1:012d}.{folder}"
    fs, at = _files(spark, f"{path}/_versions/{marker}")
    fs.create(at, False).close()
    return marker


def current(spark: SparkSession, path: str, name: str = "", version: str | None = None) -> DataFrame:
    """The newest version of what is published at path, or a named one; name: one of several tables."""
    known = versions(spark, path)
    if not known or version and version not in known:
        raise FileNotFoundError(f"no version {version or ''} at {path}")
    return spark.read.parquet(f"{path}/{(version or known[-1]).split('.')[1]}/{name}".rstrip("/"))


def retire(spark: SparkSession, path: str, held: int = 2) -> int:
    """Delete all but the newest `held` versions (one at least); readers of older ones must be through. Returns how many went."""
    old = versions(spark, path)[: -max(1, held)]
    for marker in old:
        for gone in (f"{path}/_versions/{marker}", f"{path}/{marker.split('.')[1]}"):
            fs, at = _files(spark, gone)
            fs.delete(at, True)
    return len(old)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
