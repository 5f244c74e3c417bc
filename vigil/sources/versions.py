"""Tables in versions: new files beside the old ones, then one atomic switch.

    <root>/data/<name>/...          parquet files, never changed once written
    <root>/versions/00000007.json   version 7: its parts and where each lies, schema, facts

A part is a folder or file with some of the rows (a month, a bucket of keys, an event file).  A
change writes only the parts that it touches and then publishes the next version, which names
them and, unchanged, all others.  The newest version file is the pointer; it appears whole by a
rename that fails if another writer was first.  A run that fails before the switch leaves the old
version as it is; its files are found by no reader and go with ``clean``.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PART = "vigil_part"


class Folder:
    """A folder in any file system that Spark reads (names and sizes; no data passes here)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        at = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def files(self, name: str) -> dict[str, int]:
        """Bytes of each data file under ``name``, by path."""
        out, walk = {}, self._fs.listFiles(self._path(name), True)
        while walk.hasNext():
            s = walk.next()
            if not s.getPath().getName().startswith(("_", ".")):
                out[s.getPath().toString()] = s.getLen()
        return out

    def text(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put_once(self, name: str, text: str) -> bool:
        """Write a file that appears whole or not at all; False if there is one already."""
        draft, target = self._path(f".{uuid.uuid4().hex}"), self._path(name)
        self._fs.mkdirs(target.getParent())
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(target), none)
            return True
        except Exception as failed:
            if "FileAlreadyExistsException" not in str(failed):
                raise
            self._fs.delete(draft, False)
            return False

    def delete(self, path: str) -> None:
        self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(path), True)


class Conflict(RuntimeError):
    """Another writer has published a version since this one was read."""


@dataclass
class Version:
    number: int = 0
    parts: dict[str, str] = field(default_factory=dict)
    schema: str | None = None
    facts: dict = field(default_factory=dict)


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.folder = Folder(spark, self.root)

    def current(self) -> Version:
        numbers = [n for n in self.folder.names("versions") if n.endswith(".json")]
        return self.version(int(numbers[-1][:-5])) if numbers else Version()

    def version(self, number: int) -> Version:
        return Version(number, **json.loads(self.folder.text(f"versions/{number:08d}.json")))

    def read(self, version: Version | None = None, parts=None) -> DataFrame:
        """The rows of a version (default: the current one), or of some of its parts; only their
        folders are listed and read."""
        v = version or self.current()
        if v.schema is None:
            raise ValueError(f"{self.root} holds no version")
        paths = [v.parts[p] for p in sorted(v.parts if parts is None else set(parts) & set(v.parts))]
        schema = T.StructType.fromJson(json.loads(v.schema))
        # a part's folder is a root of its own, so its name adds no column
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, part: Column) -> dict[str, str]:
        """Write ``df`` beside the table, split by ``part`` (text of letters, digits and '-');
        gives the new folder of each part that got rows."""
        name = f"data/{uuid.uuid4().hex}"
        df.withColumn(PART, part).repartition(PART).write.partitionBy(PART).parquet(f"{self.root}/{name}")
        return {n.split("=", 1)[1]: f"{self.root}/{name}/{n}" for n in self.folder.names(name) if n.startswith(PART + "=")}

    def publish(self, base: Version, changed: dict[str, str | None], schema: T.StructType | None = None, **facts) -> Version:
        """The next version: ``base`` with some parts replaced, added or (None) left out."""
        parts = {p: path for p, path in (base.parts | changed).items() if path is not None}
        new = Version(base.number + 1, parts, schema.json() if schema else base.schema, base.facts | facts)
        body = json.dumps({"parts": new.parts, "schema": new.schema, "facts": new.facts})
        if not self.folder.put_once(f"versions/{new.number:08d}.json", body):
            raise Conflict(f"version {new.number} of {self.root} was published by another writer")
        return new

    def overwrite(self, df: DataFrame, part: Column, **facts) -> Version:
        """Publish ``df`` as the whole table."""
        base = self.current()
        new = self.write(df, part)
        return self.publish(base, dict.fromkeys(base.parts) | new, df.schema, **facts)

    def append(self, df: DataFrame, part: str, **facts) -> Version:
        """Publish the rows of ``df`` as one more part."""
        base = self.current()
        path = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.publish(base, {part: path}, df.schema, **facts)

    def clean(self, keep: int = 2) -> list[str]:
        """Delete data that none of the last ``keep`` versions names; call it while nobody writes."""
        numbers = [int(n[:-5]) for n in self.folder.names("versions") if n.endswith(".json")][-keep:]
        used = {p for n in numbers for p in self.version(n).parts.values()}
        gone = []
        for name in self.folder.names("data"):
            at = f"{self.root}/data/{name}"
            if not any(p == at or p.startswith(at + "/") or f"/data/{name}/" in p for p in used):
                self.folder.delete(at)
                gone.append(name)
        return gone
