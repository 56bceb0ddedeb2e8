"""What the engine needs of the cluster: its sources on the executors, the shared folder, small files in any store."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package's sources to the executors, once a Spark application; Python workers import them from there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="plinth-src-"), "plinth.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes see: spark.checkpoint.dir; where it is unset (tests), a temporary one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="plinth-")
        atexit.register(shutil.rmtree, found.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class _Made(threading.local):
    """What a thread has made: another thread's queries may still read theirs."""

    def __init__(self):
        self.paths: list[str] = []


_made = _Made()


def fresh_path(spark: SparkSession, label: str) -> str:
    _made.paths.append(f"{shared_dir(spark)}/plinth/{label}-{uuid.uuid4().hex}")
    return _made.paths[-1]


def mark() -> int:
    """A point in time that sweep() takes."""
    return len(_made.paths)


def sweep(spark: SparkSession, since: int, *keep: str) -> None:
    """Deletes what was made under fresh paths since a mark, but for some: intermediate tables that nothing reads any more."""
    for path in _made.paths[since:]:
        if path not in keep:
            delete(spark, path)
    _made.paths[since:] = [p for p in _made.paths[since:] if p in keep]


def settle(spark: SparkSession) -> bool:
    """Has the driver's JVM collect its garbage if its heap has grown beyond 45 % of its bound: plans that have run leave
    much, and a heap grows to its bound before the JVM would look at them.  Live data is about an eighth of that."""
    runtime = spark._jvm.Runtime.getRuntime()
    grown = runtime.totalMemory() > 0.45 * runtime.maxMemory()
    if grown:
        spark._jvm.System.gc()
    return grown


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small UTF-8 file of any store Spark reads, None if there is none."""
    fs, at = _file(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, at = _file(spark, path)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}.v*"))
    return sorted(int(f.getPath().getName().rpartition(".v")[2]) for f in found or [])


def read_versioned(spark: SparkSession, path: str) -> str | None:
    """The newest version of a small file, None if there is none."""
    found = _versions(spark, path)
    return read_text(spark, f"{path}.v{found[-1]:010d}") if found else None


def write_versioned(spark: SparkSession, path: str, text: str) -> None:
    """Writes a draft beside the file and renames it to the next version, so that readers see an old text or the new one
    whole, whenever the writer stops.  The version before is kept, older ones go."""
    found = _versions(spark, path)
    target = f"{path}.v{(found[-1] + 1 if found else 1):010d}"
    fs, at = _file(spark, target)
    if fs.exists(at):
        raise FileExistsError(f"{target}: another writer was first")
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(draft, at):
        raise OSError(f"{target} could not be written")
    for old in found[:-1]:
        delete(spark, f"{path}.v{old:010d}")
