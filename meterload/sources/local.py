"""Trees of many small text files on a file system that all machines mount, written and read by tasks.

Spark goes through Hadoop's local file system, which starts a process for each folder and file to set its permissions, and
its driver lists and holds every file that a pattern matches. Here the tasks do both with calls of the operating system;
the driver sees the names of one level of folders. Other stores are left to Spark's own writer and reader.
"""

from __future__ import annotations

import os
import re
import shutil
import stat
import uuid
from collections.abc import Iterator, Sequence
from contextlib import suppress
from fnmatch import fnmatchcase
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterload.sources.tables import stored

#: Folder of a NULL key, and the characters that a folder's name has as %XX, as Spark writes them.
NO_KEY, ESCAPED = "__HIVE_DEFAULT_PARTITION__", re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")
#: Suffixes of compressed files.
PACKED = (".gz", ".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz")
#: Bytes of a file that one row of a list of files stands for, and that a task holds as lines at a time.
BLOCK, CHUNK = 32 << 20, 1 << 20
#: Rows of a batch.
ROWS = 10_000


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system has it, None if it is in another store."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.makeQualified(place).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _tasks(spark: SparkSession, rows: int) -> int:
    return max(1, min(rows, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def write_lines(df: DataFrame, root: str, keys: Sequence[str]) -> None:
    """CSV files with a header below a new folder, one per task and combination of keys; rows come dealt and sorted by them.

    A file has a hidden name until it is whole, so a task may be run again. A write that fails removes the tree.
    """
    columns = [c for c in df.columns if c not in keys]
    head = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(c) for c in columns]))).first()[0]
    name, n = f"part-{{:05d}}-{uuid.uuid4()}.c000.csv", len(keys)

    def folder(values: Sequence[str]) -> str:
        texts = (v if v == NO_KEY else ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", v) for v in values)
        return "/".join([root, *[f"{k}={v}" for k, v in zip(keys, texts)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        last = name.format(task.partitionId())
        hidden = f".{last}.{task.taskAttemptId()}"
        at, place, out = None, None, None
        try:
            for batch in batches:
                rows = zip(*[c.to_pylist() for c in batch.columns])
                for values, group in groupby(rows, key=lambda r: r[:n]):
                    if values != at:
                        if out:
                            out.close()
                            os.replace(f"{place}/{hidden}", f"{place}/{last}")
                        at, place, out = values, folder(values), None
                        try:
                            out = open(f"{place}/{hidden}", "wb")
                        except FileNotFoundError:
                            os.makedirs(place, exist_ok=True)
                            out = open(f"{place}/{hidden}", "wb")
                        out.write(head.encode() + b"\n")
                    out.writelines([r[n] + b"\n" for r in group if r[n] is not None])
            if out:
                out.close()
                os.replace(f"{place}/{hidden}", f"{place}/{last}")
                out = None
        finally:
            if out:
                out.close()
                with suppress(OSError):
                    os.remove(f"{place}/{hidden}")
        yield from ()

    line = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in columns])).cast("binary")
    if len(columns) == 1:  # Spark gives a row without any text no line
        line = F.when(F.col(f"`{columns[0]}`").isNotNull(), line)
    os.makedirs(root)
    try:
        df.select(*keys, line.alias("_line")).mapInArrow(run, "done BOOLEAN").write.format("noop").mode("overwrite").save()
    except BaseException:
        shutil.rmtree(root, ignore_errors=True)
        raise
    open(f"{root}/_SUCCESS", "wb").close()


def _below(folder: str, parts: Sequence[str]) -> Iterator[str]:
    """What matches a pattern's parts below a folder."""
    if not parts:
        yield folder
        return
    names = [parts[0]]
    if re.search(r"[*?]", parts[0]):
        with suppress(FileNotFoundError, NotADirectoryError):
            names = [name for name in os.listdir(folder) if fnmatchcase(name, parts[0])]
    for name in names:
        yield from _below(f"{folder}/{name}", parts[1:])


def _hidden(name: str) -> bool:
    """Names that Spark's readers pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def list_files(spark: SparkSession, pattern: str) -> DataFrame | None:
    """(path, start, stop): the blocks of all files that match a pattern, listed by tasks below its first level with a
    wildcard. None where Spark has to read: other stores, other patterns than with * and ?, packed files, folders, nothing.
    """
    root = None if re.search(r"[\[\]{}\\]", pattern) else local_path(spark, pattern)
    parts = (root or "").strip("/").split("/")
    level = next((i for i, part in enumerate(parts) if re.search(r"[*?]", part)), None)
    if level is None:
        return None
    heads = [(path,) for path in _below("/" + "/".join(parts[:level]), parts[level:level + 1])]
    rest = parts[level + 1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for head in batch.column(0).to_pylist():
                for path in _below(head, rest):
                    try:
                        found = os.stat(path)
                    except (FileNotFoundError, NotADirectoryError):
                        continue
                    plain = stat.S_ISREG(found.st_mode)
                    if plain and _hidden(os.path.basename(path)):
                        continue
                    plain = plain and not path.endswith(PACKED)
                    for start in range(0, max(found.st_size, 1), BLOCK):
                        rows.append((path, start, min(start + BLOCK, found.st_size), plain))
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        values = [pa.array(v, t) for v, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.bool_()))]
        return pa.RecordBatch.from_arrays(values, names=["path", "start", "stop", "plain"])

    table = spark.createDataFrame(heads, "head STRING").repartition(_tasks(spark, len(heads)))
    files = stored(table.mapInArrow(run, "path STRING, start LONG, stop LONG, plain BOOLEAN"), "files")
    blocks, plain = files.agg(F.count("*"), F.bool_and("plain")).first()
    return files.select("path", "start", "stop").repartition(_tasks(spark, blocks)) if plain else None


def _chunks(path: str, start: int, stop: int) -> Iterator[list[bytes]]:
    """The lines that begin in a block of a file, without blank ones and the header."""
    blank = bytes(range(33))
    with open(path, "rb") as file:
        if start:  # a line that begins at `start` has the end of another before it
            file.seek(start - 1)
            file.readline()
        elif file.read(3) != b"\xef\xbb\xbf":
            file.seek(0)
        header = not start
        while (at := file.tell()) < stop:
            size = min(CHUNK, stop - at)  # readlines() goes on until it has more than the given number of bytes
            read = file.readlines(size - 1) if size > 1 else [line for line in [file.readline()] if line]
            if not read:
                return
            lines = [line for text in read for line in text.splitlines() if line.strip(blank)]
            if header and lines:
                header = False
                del lines[0]
            yield lines


def _uri(path: str) -> str:
    """As Spark gives the path of a file that a pattern matches."""
    return "file:" + re.sub(
        r"[^\w\-!.~'()*,;:$&+=@/]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()) if m[0] < "\x80" else m[0], path)


def read_lines(files: DataFrame) -> DataFrame:
    """(path, value): the lines of listed files without their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, texts, held = [], [], 0
            for path, start, stop in zip(*[c.to_pylist() for c in batch.columns]):
                name = _uri(path)
                for lines in _chunks(path, start, stop):
                    paths.append(name)
                    texts.append([line.decode("utf-8", "replace") for line in lines])
                    held += len(lines)
                    if held >= ROWS:
                        yield _batch(paths, texts)
                        paths, texts, held = [], [], 0
            if paths:
                yield _batch(paths, texts)

    def _batch(paths: list[str], texts: list[list[str]]) -> pa.RecordBatch:
        values = [pa.array(paths, pa.string()), pa.array(texts, pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(values, names=["path", "lines"])

    return files.mapInArrow(run, "path STRING, lines ARRAY<STRING>").select("path", F.explode("lines").alias("value"))
