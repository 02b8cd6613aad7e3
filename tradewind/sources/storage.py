"""File-system calls on metadata only, through the file system that Spark itself uses."""

from __future__ import annotations

import os
import threading
import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

#: Looks at a numbered file that has no text yet, 0.2 seconds apart.
PATIENCE = 25
#: Creations of this process go one by one, because a local file system looks and creates in two steps.
_creating = threading.Lock()
#: Threads that rename the files of a folder.
MOVERS = 16


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def local_path(spark: SparkSession, path: str) -> str | None:
    """The plain path of a file or folder of the local file system, shared or not; None for any other."""
    uri = _fs(spark, path).makeQualified(_path(spark, path)).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def make_dirs(spark: SparkSession, path: str) -> None:
    _fs(spark, path).mkdirs(_path(spark, path))


def rename(spark: SparkSession, source: str, target: str) -> None:
    if not _fs(spark, source).rename(_path(spark, source), _path(spark, target)):
        raise OSError(f"could not rename {source} to {target}")


def _rename_local(source: str, target: str, pairs: Sequence[tuple[str, str]]) -> None:
    """Rename files with their checksum files, as the file system does; one that the new name had before goes."""
    for old, new in pairs:
        os.rename(f"{source}/{old}", f"{target}/{new}")
        try:
            os.rename(f"{source}/.{old}.crc", f"{target}/.{new}.crc")
        except FileNotFoundError:
            with suppress(FileNotFoundError):
                os.unlink(f"{target}/.{new}.crc")


def rename_all(spark: SparkSession, source: str, target: str, pairs: Sequence[tuple[str, str]]) -> None:
    """Rename files of one folder to names in another one; each file takes three short calls, a local one none."""
    here, there = local_path(spark, source), local_path(spark, target)
    if here and there:
        _rename_local(here, there, pairs)
        return
    path, fs = spark._jvm.org.apache.hadoop.fs.Path, _fs(spark, source)

    def move(part: Sequence[tuple[str, str]]) -> None:
        for old, new in part:
            if not fs.rename(path(f"{source}/{old}"), path(f"{target}/{new}")):
                raise OSError(f"could not rename {source}/{old} to {target}/{new}")

    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(move, [pairs[start::MOVERS] for start in range(min(MOVERS, len(pairs)))]))


def try_rename(spark: SparkSession, source: str, target: str) -> bool:
    """Rename, or False when the source is gone or the target is there."""
    if exists(spark, target):
        return False
    try:
        return _fs(spark, source).rename(_path(spark, source), _path(spark, target))
    except Py4JJavaError:
        if exists(spark, source):
            raise
        return False


def remove(spark: SparkSession, path: str) -> None:
    _fs(spark, path).delete(_path(spark, path), True)


def glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in name order."""
    found = _fs(spark, pattern).globStatus(_path(spark, pattern)) or []
    return sorted(status.getPath().toString() for status in found)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Base names in a folder, in order; none when there is no such folder."""
    return [path.rpartition("/")[2] for path in glob(spark, f"{folder}/*")]


def names_like(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    """Base names in a folder that match, in order; they come in one text, however many there are."""
    if not exists(spark, folder):
        return []
    hadoop, fs = spark._jvm.org.apache.hadoop.fs, _fs(spark, folder)
    found = hadoop.FileUtil.stat2Paths(fs.listStatus(_path(spark, folder), hadoop.GlobFilter(pattern)))
    root = fs.makeQualified(_path(spark, folder)).toString().rstrip("/")
    text = spark._jvm.scala.Predef.genericWrapArray(found).mkString("\n")
    return sorted(text.removeprefix(f"{root}/").split(f"\n{root}/")) if text else []


def files_below(spark: SparkSession, folder: str) -> list[str]:
    """Paths of all files below a folder, relative to it; those found so far if somebody removes the folder meanwhile."""
    fs, found = _fs(spark, folder), []
    try:
        root = fs.makeQualified(_path(spark, folder)).toString()
        entries = fs.listFiles(_path(spark, folder), True)
        while entries.hasNext():
            found.append(entries.next().getPath().toString()[len(root) + 1 :])
    except Py4JJavaError:
        if exists(spark, folder):
            raise
    return sorted(found)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False when it is there already. Only one of several writers can succeed."""
    try:
        with _creating:
            stream = _fs(spark, path).create(_path(spark, path), False)
    except Py4JJavaError:
        if exists(spark, path):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def _filled_text(spark: SparkSession, path: str) -> str:
    """The text of a small file; none while its writer is between the text and its checksum."""
    try:
        return read_text(spark, path)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() in ("ChecksumException", "EOFException"):
            return ""
        raise


def last_numbered(spark: SparkSession, folder: str) -> tuple[int, str]:
    """The highest numbered file of a folder and its text; 0 and no text without any.

    A file without text belongs to a writer that is about to fill it, so it is looked at again for a while.
    After that its writer is taken to be lost: the number stays used and the text before it counts.
    """
    numbers = names(spark, folder)
    for _ in range(PATIENCE):
        text = _filled_text(spark, f"{folder}/{numbers[-1]}") if numbers else "-"
        if text:
            break
        time.sleep(0.2)
    for number in reversed(numbers):
        text = read_text(spark, f"{folder}/{number}")
        if text:
            return int(numbers[-1]), text
    return int(numbers[-1]) if numbers else 0, ""


def create_numbered(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Create a numbered file; False when another writer has taken the number."""
    return create_new(spark, f"{folder}/{number:012d}", text)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
