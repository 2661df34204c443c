"""Helpers the text operators share: durable intermediate tables, word splitting, column checks."""
from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import zipfile
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

import tidespine
from tidespine.session import scratch_path

#: The characters that belong to a word, and the ASCII characters that part words.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Byte table of the same rule: capitals become small letters, every other separator a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A-Z; null has none."""
    return (text or "").encode().translate(WORD_BYTES).split()


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else (``lower`` would also touch other alphabets)."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Setting while a table is stored: shuffle files of the finished write go at once, as nothing reads them again.
WHILE_STORING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: What a Python worker is sent at a time, where the session does not say: few rows, as each holds a whole text.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends at files any executor can read."""
    return _written(df, scratch_path(df.sparkSession, label))


def _written(df: DataFrame, path: str) -> DataFrame:
    conf = df.sparkSession.conf
    before = {k: conf.get(k, None) for k in WHILE_STORING}
    for k, v in WHILE_STORING.items():
        conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables of a job, dropped as soon as the job has read them for the last time."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.paths.append(scratch_path(self.spark, label))
        return _written(df, self.paths[-1])

    def drop(self) -> None:
        """Delete what was stored so far; its DataFrames must not be read any more."""
        for name in self.paths:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python once a session, whatever their path is, and the session small Arrow batches unless it has its own.
    The archive is read by the driver alone."""
    for k, v in BATCHES.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    app, root = spark.sparkContext.applicationId, Path(tidespine.__file__).parent
    if app in _shipped or not root.is_dir():
        return
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for f in sorted(root.rglob("*.py")):
            archive.write(f, f.relative_to(root.parent))
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # served to executors until the session ends
    target = Path(folder) / "tidespine.zip"
    target.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


_kept: dict[str, Any] = {}


def kept(key: str, build: Callable[[], Any]) -> Any:
    """What ``build`` makes, kept for the next tasks of this Python worker; whatever else was kept goes."""
    if key not in _kept:
        release()
        _kept[key] = build()
    return _kept[key]


def release() -> None:
    """Drop what earlier tasks of other operators have left in a reused Python worker."""
    _kept.clear()
    pa.default_memory_pool().release_unused()


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", rows: int = 2000, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that one slice holds few rows and, unless one text is longer, at most ``size`` bytes of text."""
    for batch in batches:
        col, at = batch.column(batch.schema.get_field_index(text)), 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and col.slice(at, n).nbytes > size:
                n //= 2
            yield batch.slice(at, n)
            at += n
