"""Files in any store that Spark reads, by Hadoop's file system from the driver: listing, small
texts, hashes of files of any size and publishing by rename. Paths may have a scheme or not."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A byte order mark, which spreadsheet programs expect.
BOM = "﻿"


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def qualified(self, path: str) -> str:
        """The whole path, so that two names of one file are equal."""
        fs, p = self._at(path)
        return self._jvm.org.apache.hadoop.fs.Path(fs.makeQualified(p).toUri().normalize()).toString().rstrip("/")

    def parent(self, path: str) -> str:
        return self.qualified(path).rsplit("/", 1)[0]

    def name(self, path: str) -> str:
        return self.qualified(path).rsplit("/", 1)[1]

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def is_file(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p) and fs.getFileStatus(p).isFile()

    def children(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)]

    def read_text(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def sha256(self, path: str) -> str:
        """Streamed in the JVM: no more than a buffer of the file is in memory."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def reference(self, path: str) -> dict[str, str]:
        """Name and hash; no parent folder leaks."""
        return {"name": self.name(path), "sha256": self.sha256(path)}

    def _replace(self, source: str, target: str) -> None:
        """One rename, which puts the new file in the old one's place."""
        _, s = self._at(source)
        fs, t = self._at(target)
        option = self._jvm.org.apache.hadoop.fs.__getattr__("Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(option, 1)
        options[0] = option.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(fs.makeQualified(s), fs.makeQualified(t), options)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def publish_text(self, path: str, text: str) -> None:
        """Written aside, then renamed: readers see the old file or the new one."""
        aside = f"{self.parent(path)}/_{self.name(path)}-{uuid.uuid4().hex}"
        fs, p = self._at(aside)
        try:
            stream = fs.create(p, True)
            try:
                stream.write(bytearray(text.encode()))
            finally:
                stream.close()
            self._replace(aside, path)
        finally:
            self.delete(aside)

    def publish_json(self, path: str, value: dict) -> None:
        """NaN is refused."""
        self.publish_text(path, json.dumps(value, indent=2, sort_keys=True, allow_nan=False) + "\n")

    def publish_csv(self, df: DataFrame, path: str, bom: bool = True) -> None:
        """A report table as one CSV file with a header and a byte order mark, in the order of df.
        One task writes it, so it is for reports; tables of any size go to write_csv. A write that
        fails leaves the old file."""
        aside = f"{self.parent(path)}/_{self.name(path)}-{uuid.uuid4().hex}"
        first, *rest = df.columns
        out = df.toDF((BOM if bom else "") + first, *rest).coalesce(1)
        try:
            out.write.option("header", True).option("emptyValue", "").option("encoding", "UTF-8").csv(aside)
            fs, p = self._at(aside)
            files = [s.getPath().toString() for s in fs.listStatus(p) if s.getPath().getName().startswith("part-")]
            if files:
                self._replace(files[0], path)
            else:  # no partition at all
                self.publish_text(path, (BOM if bom else "") + ",".join(df.columns) + "\n")
        finally:
            self.delete(aside)
