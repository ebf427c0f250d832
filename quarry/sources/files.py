"""Files of a store on any file system that Spark reads: small ones whole, commits without overwriting."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.jvm, self.conf = spark, spark._jvm, spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, folder: str) -> list[str]:
        """The names in a folder, hidden ones aside; none where there is no such folder."""
        where = self.path(folder)
        found = [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []
        return sorted(n for n in found if n[0] not in "._")

    def sizes(self, folder: str) -> dict[str, int]:
        """The bytes of all files below each name in a folder."""
        root, out = self.fs.makeQualified(self.path(folder)), {}
        below = self.fs.listFiles(root, True)
        while below.hasNext():
            f = below.next()
            name = f.getPath().toString().removeprefix(f"{root}/").split("/")[0]
            out[name] = out.get(name, 0) + f.getLen()
        return out

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> bool:
        """Make the file ``name``, whole or not at all; False where there already is one."""
        target = self.fs.makeQualified(self.path(name))
        draft = self.path(f"{target.getParent()}/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(draft, target, options)
            return True
        except Exception as e:
            self.fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                return False
            raise

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
