"""Several tables committed at once: staging folders and one manifest.

A commit writes the parts of its tables into new folders, which no reader knows, and then moves one small manifest into place, which names the folders
of every table. Readers take the last manifest, so they see all tables of one commit or none of it; a commit that fails leaves
folders that nothing names, and the next ``vacuum`` removes them. Tables that a commit doesn't name stay as they were.

A table may be kept in buckets of its key: an upsert reads and rewrites the buckets its rows fall into, and the manifest names the others'
folders again.

Edge cases: a commit number that is there already is left as it is, so a batch that runs again changes nothing; two writers of one number: one
of them gets an error; an empty batch is a commit; of rows of one key the one with the greatest order counts, nulls last, and ties go by a hash of the
row; a null key is a key; an unknown table, or a commit before the first, reads as an error, or as empty if a schema is given.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 16
WHOLE = "all"


class Tables:
    """The tables kept below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)

    def commits(self) -> list[int]:
        """The numbers of the commits that readers may see, in order."""
        at = self._path(f"{self.folder}/manifests")
        if not self._fs.exists(at):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(at)]
        return sorted(int(n[1:13]) for n in names if n[:1] == "m" and n.endswith(".json"))

    def manifest(self, commit: int | None = None, before: int | None = None) -> dict:
        """The manifest of a commit, or of the last one (before a number)."""
        there = [c for c in self.commits() if (commit is None or c == commit) and (before is None or c < before)]
        if not there:
            return {"commit": None, "tables": {}}
        row = self.spark.read.text(f"{self.folder}/manifests/m{there[-1]:012d}.json", wholetext=True).first()
        return json.loads(row.value)

    def read(self, table: str, schema: StructType | None = None, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table as the last manifest, or the given one, names it; tables of one state are read with one manifest."""
        entry = (self.manifest() if manifest is None else manifest)["tables"].get(table)
        if entry is None and schema is None:
            raise KeyError(table)
        kind = schema if entry is None else StructType.fromJson(entry["schema"])
        paths = [] if entry is None else [p for b, p in entry["parts"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(kind).parquet(*[f"{self.folder}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], kind)

    def commit(self, number: int, replaced: dict[str, DataFrame] | None = None, upserts: dict[str, tuple[DataFrame, str, str]] | None = None) -> bool:
        """Writes tables whole, or upserts rows by (rows, key, order), as one commit; false if the number is there already."""
        if number in self.commits():
            return False
        base = self.manifest(before=number)
        tables, attempt = dict(base["tables"]), f"data/c{number:012d}-{uuid.uuid4().hex}"
        for name, df in (replaced or {}).items():
            df.write.parquet(f"{self.folder}/{attempt}/{name}/{WHOLE}")
            tables[name] = {"schema": df.schema.jsonValue(), "key": None, "parts": {WHOLE: f"{attempt}/{name}/{WHOLE}"}}
        for name, (rows, key, order) in (upserts or {}).items():
            tables[name] = self._upserted(name, rows, key, order, base, attempt)
        self._publish(number, {"commit": number, "tables": tables})
        return True

    def _upserted(self, name: str, rows: DataFrame, key: str, order: str, base: dict, attempt: str) -> dict:
        entry = base["tables"].get(name)
        if entry is not None and entry["key"] != key:
            raise ValueError(f"{name} isn't kept by {key}")
        cols = rows.columns
        bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")
        rest = [c for c in cols if c != key]
        rank = F.struct(F.col(order).isNotNull(), F.col(order), F.xxhash64(*cols))
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("__x")).select(F.col(key), *[F.col(f"__x.{c}").alias(c) for c in rest])
        parts = dict(entry["parts"]) if entry else {}
        touched = sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())  # BUCKETS numbers at most
        if touched:
            held = self.read(name, rows.schema, base, touched).select(*cols)
            here, there = last.withColumn("__new", F.lit(True)), held.withColumn("__new", F.lit(False))
            one = there.unionByName(here).groupBy(key).agg(F.max_by(F.struct(*rest), "__new").alias("__x"))
            now = one.select(F.col(key), *[F.col(f"__x.{c}").alias(c) for c in rest]).select(*cols)
            now.withColumn("__bucket", bucket).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{attempt}/{name}")
            parts |= {str(b): f"{attempt}/{name}/__bucket={b}" for b in touched}
        return {"schema": rows.schema.jsonValue(), "key": key, "parts": parts}

    def _publish(self, number: int, manifest: dict) -> None:
        final, staged = (self._path(f"{self.folder}/manifests/{n}") for n in (f"m{number:012d}.json", f"_{uuid.uuid4().hex}"))
        self._fs.mkdirs(final.getParent())
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        rename = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.NONE  # an existing manifest isn't replaced
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf).rename(self._fs.makeQualified(staged), self._fs.makeQualified(final), how)

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the last commits, with the folders that only they name, and what failed commits left; how many folders went. No commit may be under way."""
        commits = self.commits()
        kept = commits[-keep:] if keep else []
        named = {p.split("/")[1] for c in kept for t in self.manifest(c)["tables"].values() for p in t["parts"].values()}
        for c in commits:
            if c not in kept:
                self._fs.delete(self._path(f"{self.folder}/manifests/m{c:012d}.json"), False)
        data, gone = self._path(f"{self.folder}/data"), 0
        for s in self._fs.listStatus(data) if self._fs.exists(data) else []:
            if s.getPath().getName() not in named:
                self._fs.delete(s.getPath(), True)
                gone += 1
        return gone
