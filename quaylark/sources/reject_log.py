"""A log of rejected files that several writers share: insert if absent, with optimistic commits.

The log is a folder of numbered commits, each a small file that names one Parquet
folder of (path, error), and is made only if no file of that number exists.  A
writer reads the log up to its last commit, leaves out the paths that it knows,
writes the others, and tries the next number.  If another writer was faster, it
reads what that one added, leaves those paths out too, and tries again.  So each
path is in the log once, with the error that was committed first, and a reader
sees whole commits only.  Data that was never committed is never read.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .recordings import _file_system

REJECTS = "path string, error string"
#: Commits after which a writer folds the log into one folder.
FOLD_AFTER = 50


def _create(spark: SparkSession, path: str, content: str) -> bool:
    """Make a file with its whole content, or return False if there is one of that name already."""
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    system, plain = _file_system(tmp)
    with system.open_output_stream(plain) as f:
        f.write(content.encode())
    target = _file_system(path)[1]
    if system.type_name == "local":
        try:
            os.link(plain, target)  # fails if the target exists, and never shows part of it
            return True
        except FileExistsError:
            return False
        finally:
            os.remove(plain)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hadoop(path).toUri(), conf)
    try:
        context.rename(hadoop(tmp), hadoop(path), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))  # does not overwrite
        return True
    except Exception as e:  # noqa: BLE001
        with contextlib.suppress(OSError):
            system.delete_file(plain)
        if "FileAlreadyExists" in str(e):
            return False
        raise


class RejectLog:
    """The log below a folder that all writers and readers share (a path or URI)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> list[int]:
        from pyarrow import fs

        system, root = _file_system(f"{self.folder}/log")
        found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json"))

    def _entry(self, version: int) -> dict:
        system, path = _file_system(f"{self.folder}/log/{version:020d}.json")
        with system.open_input_file(path) as f:
            return json.loads(f.read())

    def version(self) -> int:
        """The last commit, 0 if there is none: a cheap sign of whether there is anything new."""
        return max(self._commits(), default=0)

    def _folders(self, version: int, after: int = 0) -> list[str]:
        """Data folders of the commits after `after` up to `version`; a fold stands for all before it."""
        out = []
        for n in range(version, after, -1):  # commits are numbered without gaps
            entry = self._entry(n)
            if entry["folds"] and n - 1 > after and entry["folds"] <= after:
                continue  # what it folds is known
            out += entry["data"]
            if entry["folds"]:
                break
        return out

    def read(self, version: int | None = None) -> DataFrame:
        """(path, error) as of a commit, the last one unless stated."""
        folders = self._folders(self.version() if version is None else version)
        return self.spark.read.schema(REJECTS).parquet(*folders) if folders else self.spark.createDataFrame([], REJECTS)

    def contains(self, files: DataFrame) -> DataFrame:
        """The rows of files (path, ...) that the log names, with their error."""
        return files.join(self.read(), "path")

    def without(self, files: DataFrame) -> DataFrame:
        return files.join(self.read().select("path"), "path", "left_anti")

    def add(self, rejects: DataFrame, most_tries: int = 1000) -> int:
        """Add (path, error) whose path is not in the log yet; the commit's number, or the last one if there was nothing to add.

        Of rows that repeat a path the smallest error is kept; a null path is left out.
        """
        new = rejects.where("path is not null").groupBy("path").agg(F.min("error").alias("error"))
        seen = self.version()
        new = self._kept(new.join(self.read(seen).select("path"), "path", "left_anti"))
        for _ in range(most_tries):
            if new is None:
                return seen
            entry = {"data": [new], "folds": 0}
            if _create(self.spark, f"{self.folder}/log/{seen + 1:020d}.json", json.dumps(entry)):
                self._fold(seen + 1)
                return seen + 1
            now = self.version()  # others were faster: leave out what they added
            added = self.spark.read.schema(REJECTS).parquet(*self._folders(now, seen))
            new = self._kept(self.spark.read.schema(REJECTS).parquet(new).join(added.select("path"), "path", "left_anti"))
            seen = now
        raise TimeoutError(f"the log changed under {most_tries} tries")

    def _kept(self, rows: DataFrame) -> str | None:
        """Write rows to a folder of their own; None if there are none."""
        system, root = _file_system(f"{self.folder}/log")
        system.create_dir(root, recursive=True)
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return None if self.spark.read.schema(REJECTS).parquet(path).isEmpty() else path

    def _fold(self, version: int) -> None:
        """Every FOLD_AFTER commits, one more that stands for all of them; losing the race for its number does no harm."""
        if version % FOLD_AFTER == 0:
            path = self._kept(self.read(version))
            _create(self.spark, f"{self.folder}/log/{version + 1:020d}.json", json.dumps({"data": [path], "folds": version}))
