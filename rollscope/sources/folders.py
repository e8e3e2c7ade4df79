"""Very many small files in a folder of the ``file:`` scheme, written, listed and read by tasks.

Hadoop's local file system starts a process (``chmod``) for each file that it makes, and twice with
checksums; Spark's sources keep every file's name on the driver and make a codec factory
for each file they open.  That is milliseconds a file, so a table with a file or folder
for each key is bound by them.  Here tasks write, list and read the files themselves.  The
folder must be shared, as it must for Spark's own writers.  Folders of other
schemes have no local path: callers leave them to Spark's sources.
"""
from __future__ import annotations

import bz2
import gzip
import os
import re
import uuid
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 1 << 23                # bytes of a file that are read as one row
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
_SPECIAL = re.compile(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]")       # what Spark escapes in the names of folders
_PACKED = {".gz": gzip.open, ".bz2": bz2.open}
_UNREAD = (".deflate", ".snappy", ".lz4", ".zst")


def local_path(spark: SparkSession, path: str) -> str | None:
    """``path`` in the file system of the machine, or None if its scheme is another one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(p).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def there(spark: SparkSession, path: str) -> str | None:
    """``local_path`` of a file or folder that exists, else None."""
    at = local_path(spark, path)
    return at if at and os.path.exists(at) else None


def _tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# -------------------------------------------------------------------- writing
def _part(key: str, value: str | None) -> str:
    return f"{key}=" + (_SPECIAL.sub(lambda m: f"%{ord(m[0]):02X}", value) if value else NO_VALUE)


def write_folders(df: DataFrame, root: str, keys: Sequence[str], value: str, suffix: str, named: bool = False) -> None:
    """The lines ``value`` in files ``root/key=../key=../part-..``, or, if ``named``, in one file ``key=..`` for the last
    key.  The rows of a task must lie by keys already (``sortWithinPartitions``), and the rows of a named file in one task.

    A file is written under a hidden name and gets its own when it is whole; names depend on the
    task, not on its attempt, so a retried task replaces its files.  Existing files of other calls stay."""
    job, keys = uuid.uuid4().hex, list(keys)
    os.makedirs(root, exist_ok=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        key, out, hidden, final, n, made = None, None, "", "", 0, ""
        try:
            for b in batches:
                rows = zip(zip(*(c.to_pylist() for c in b.columns[:-1])), b.columns[-1].to_pylist())
                for k, group in groupby(rows, itemgetter(0)):
                    if k != key:
                        if out:
                            out.close()
                            os.replace(hidden, final)
                        names, key = [_part(*x) for x in zip(keys, k)], k
                        name = f"{names.pop()}{suffix}" if named else f"part-{part:05d}-{job}{suffix}"
                        folder = os.path.join(root, *names)
                        if folder != made:
                            os.makedirs(folder, exist_ok=True)
                            made = folder
                        hidden, final = f"{folder}/.{name}.{attempt}", f"{folder}/{name}"
                        out = open(hidden, "wb")
                        n += 1
                    out.write(b"".join((x or b"") + b"\n" for _, x in group))
            if out:
                out.close()
                os.replace(hidden, final)
        finally:
            if out:
                out.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    lines = df.select(*[F.col(k).cast("string") for k in keys], F.col(value).cast("binary").alias("value"))
    lines.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    open(os.path.join(root, "_SUCCESS"), "wb").close()


# -------------------------------------------------------------------- listing
def _hidden(name: str) -> bool:
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name


def _list(deep: bool):
    """Rows (path, size): a folder (no size) becomes its entries, by one level or down to its files."""
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, sizes = [], []

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "size": pa.array(sizes, pa.int64())})
            paths.clear(), sizes.clear()
            return out

        for b in batches:
            for path, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if size is not None:
                    paths.append(path), sizes.append(size)
                    continue
                todo = [path]
                while todo:
                    with os.scandir(todo.pop()) as entries:
                        for e in entries:
                            if _hidden(e.name):
                                continue
                            if not e.is_dir():
                                paths.append(e.path), sizes.append(e.stat().st_size)
                            elif deep:
                                todo.append(e.path)
                            else:
                                paths.append(e.path), sizes.append(None)
                            if len(paths) >= 10000:
                                yield batch()
        if paths:
            yield batch()
    return go


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size) of every file under ``root``; its folders are listed by tasks, none by the driver.  Names that begin with
    ``.`` or ``_`` are left out, as Spark does."""
    size = os.path.getsize(root) if os.path.isfile(root) else None
    found = spark.createDataFrame([(root, size)], "path string, size long").coalesce(1)
    for deep in (False, False, True):                 # two levels are dealt, so few folders at the top do not bind
        found = found.mapInArrow(_list(deep), "path string, size long").repartition(_tasks(spark))
    return found


# -------------------------------------------------------------------- reading
def _blocks(path: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the lines that begin in a range: what follows the newline at ``start - 1`` or after, up to the
    newline at ``end - 1`` or after; a packed file as blocks of whole lines."""
    ext = os.path.splitext(path)[1]
    if ext in _UNREAD:
        raise ValueError(f"cannot read {path}: {ext} files are not supported")
    if ext in _PACKED:
        with _PACKED[ext](path, "rb") as f:
            at = 0
            while text := f.read(RANGE):
                yield at, text + f.readline()
                at += 1
            return
    with open(path, "rb") as f:
        if start:
            f.seek(start - 1)
            f.readline()
        text = f.read(max(0, end - f.tell()))
        if text and not text.endswith(b"\n"):
            text += f.readline()
    yield start, text


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["path", "at", "text"])
        rows.clear()
        return out

    for b in batches:
        for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
            for at, text in _blocks(path, start, end):
                if at == 0:
                    text = text.removeprefix(b"\xef\xbb\xbf")
                text = text[:-2] if text.endswith(b"\r\n") else text[:-1] if text.endswith((b"\n", b"\r")) else text or None
                rows.append((path, at, text))
                held += len(text or b"")
                if held >= RANGE or len(rows) >= 10000:
                    yield batch()
                    held = 0
    if rows:
        yield batch()


def read_blocks(spark: SparkSession, root: str, whole: bool | None = None) -> DataFrame:
    """(path, at, text): the files under ``root`` in blocks of whole lines, without the last line's end; ``text`` is null in a block
    without lines, and ``at`` gives a file's blocks in order.  A file of more than ``RANGE`` bytes is read by several
    tasks.  ``whole`` keeps only the files of one block, or only the others."""
    packed = F.col("path").rlike("|".join(f"\\{x}$" for x in _PACKED))
    files = list_files(spark, root)
    one = ~packed & (F.col("size") <= RANGE)
    if whole is not None:
        files = files.where(one if whole else ~one)
    start = F.when(packed, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(RANGE).cast("long")))
    ranges = files.select("path", F.explode(start).alias("start"), "size").select("path", "start", F.least("size", F.col("start") + RANGE).alias("end"))
    return ranges.repartition(_tasks(spark)).mapInArrow(_read, "path string, at long, text binary").withColumn("text", F.col("text").cast("string"))


def lines_of(text) -> Column:
    """The lines of a block as an array."""
    return F.split(text, "\r\n|\r|\n")


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """(path, value): every line of every file under ``root``."""
    return read_blocks(spark, root).select("path", F.explode(lines_of("text")).alias("value"))


def key_of(path, key: str) -> Column:
    """The value of ``key`` in the folder or file names of a path."""
    got = F.regexp_extract(path, f"/{key}=([^/]*)/", 1)
    return F.when((got != "") & (got != NO_VALUE), F.url_decode(F.replace(got, F.lit("+"), F.lit("%2B"))))
