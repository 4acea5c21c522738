"""The graph's tables on storage: hash buckets of Parquet under one log of commits, and a database table over JDBC."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphfold.errors import Conflict, NotFound
from graphfold.plans.schemas import TABLES
from graphfold.plans.written import materialize

#: What a table is bucketed and sorted by, where it is not the id: edges by their ends and chunks by their node, so that a
#: hop and a node's chunks are read from few buckets.
KEYS = {"edges": "src", "edges_in": "dst", "chunks": "node_id", "members": "community_id"}
#: Copies that are bucketed by another column, and kept in the same commits.
COPIES = {"edges": "edges_in"}
#: Keys that a look-up sends to the scan as a list; more are joined.
LISTED = 1000


def bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("string")), F.lit(buckets)).cast("int")


class Store:
    """Tables below a path. A table's rows lie in hash buckets of its key, sorted by it; a change rewrites the buckets that
    it touches and leaves all other files as they are.

    The log holds one file for each commit, with the files of every table, so that a commit changes several tables at
    once or none. A transaction remembers the commit it began from. If another has come between, it goes on top of it
    where the tables that it read or wrote are still the same, and is a Conflict where they are not. A commit's file is
    renamed into place, which fails if it exists; readers never see half a commit, and what an interrupted one wrote
    goes in vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark.sparkContext._jvm
        self._jvm, self._conf = jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at("_log")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("_log"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """A commit: its version, its tables with schema, key, buckets and folders, and the last batch of each stream."""
        found = self.versions()
        if version is None and not found:
            return {"version": 0, "tables": {}, "batches": {}}
        version = found[-1] if version is None else version
        if version not in found:
            raise NotFound(f"there is no version {version}")
        stream = self._fs.open(self._at(f"_log/v{version:09d}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, manifest: dict) -> bool:
        """Whether the commit's number was free."""
        draft, to = self._at(f"_log/.{uuid.uuid4().hex}"), self._at(f"_log/v{manifest['version']:09d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self._fs.getUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(draft, to, options)
            return True
        except Exception as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise

    def _load(self, name: str, entry: dict | None, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(entry["schema"])) if entry else T._parse_datatype_string(TABLES[name])
        folders = [] if not entry else [f for b, found in entry["files"].items() if buckets is None or int(b) in buckets for f in found]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def _entry(self, name: str, version: int | None = None) -> dict | None:
        found = self.manifest(version)["tables"].get(name)
        if found is None and (name not in TABLES or version is not None):
            raise NotFound(f"there is no table {name}")
        return found

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self._load(name, self._entry(name, version))

    def begin(self, batch: tuple[str, int] | None = None) -> Transaction:
        return Transaction(self, batch)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Replaces a table."""
        t = self.begin()
        t.put(name, df)
        t.commit()
        return self.read(name)

    def lookup(self, name: str, keys: Sequence[str]) -> DataFrame:
        """The rows of some keys, from their buckets alone."""
        entry = self._entry(name)
        wanted = self.spark.createDataFrame([(k,) for k in keys], "k string") if keys else None
        hit = [r["b"] for r in wanted.select(bucket(F.col("k"), entry["buckets"]).alias("b")).distinct().collect()] if entry and wanted is not None else []
        return self._load(name, entry, hit).where(F.col(KEYS.get(name, "id")).isin(*keys))

    def near(self, name: str, nodes: DataFrame, small: int = LISTED) -> DataFrame:
        """The rows whose key is among nodes (node): of few, which is counted, from their buckets, by a list that the scan
        holds against row groups; of more by a join."""
        some = nodes.select(F.col("node").cast("string").alias("node")).distinct().limit(small + 1).collect()
        if len(some) <= small:
            return self.lookup(name, [r["node"] for r in some if r["node"] is not None])
        table = self.read(name)
        return table.join(nodes.select(F.col("node").alias("__node")).distinct(), table[KEYS.get(name, "id")] == F.col("__node"), "left_semi")

    def vacuum(self, keep: int = 1, older_than: float = 86_400.0) -> list[str]:
        """Deletes commits but the last `keep`, and folders that none of those holds and nobody has written to for
        older_than seconds; returns the folders."""
        found = self.versions()
        held = {f.split("/")[1] for v in found[-keep:] for t in self.manifest(v)["tables"].values() for fs in t["files"].values() for f in fs}
        for v in found[:-keep]:
            self._fs.delete(self._at(f"_log/v{v:09d}.json"), False)
        gone, limit = [], (time.time() - older_than) * 1000
        if self._fs.exists(self._at("data")):
            for s in self._fs.listStatus(self._at("data")):
                if s.getPath().getName() not in held and s.getModificationTime() <= limit:
                    self._fs.delete(s.getPath(), True)
                    gone.append(s.getPath().getName())
        return gone

    def rebucket(self, name: str, buckets: int) -> None:
        """Deals a table that has grown to another number of buckets."""
        t = self.begin()
        t.put(name, t.read(name), buckets)
        t.commit()


class Transaction:
    """Changes of several tables that become visible together."""

    def __init__(self, store: Store, batch: tuple[str, int] | None = None):
        self.store, self.batch, self.base = store, batch, store.manifest()
        self.changed: dict[str, dict] = {}
        self.seen: set[str] = set()

    @property
    def repeated(self) -> bool:
        """Whether the batch has been committed before."""
        return self.batch is not None and self.base["batches"].get(self.batch[0], -1) >= self.batch[1]

    def _now(self, name: str) -> dict | None:
        self.seen.add(name)
        found = self.changed.get(name) or self.base["tables"].get(name)
        if found is None and name not in TABLES:
            raise NotFound(f"there is no table {name}")
        return found

    def read(self, name: str) -> DataFrame:
        return self.store._load(name, self._now(name))

    def _write(self, name: str, df: DataFrame, key: str, buckets: int) -> dict[str, list[str]]:
        """Writes rows by bucket; adaptive execution divides a bucket that is much larger than others."""
        folder = f"data/{uuid.uuid4().hex}"
        dealt = df.withColumn("__bucket", bucket(F.col(key), buckets)).hint("rebalance", "__bucket").sortWithinPartitions("__bucket", key)
        writer = dealt.write.partitionBy("__bucket").option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.parquet(f"{self.store.path}/{folder}")
        names = [s.getPath().getName() for s in self.store._fs.listStatus(self.store._at(folder)) if s.isDirectory()]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names if n.startswith("__bucket=")}

    def _set(self, name: str, df: DataFrame, files: dict[str, list[str]], key: str, buckets: int) -> None:
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields])
        self.changed[name] = {"schema": schema.json(), "key": key, "buckets": buckets, "files": files}
        self.seen.add(name)

    def put(self, name: str, df: DataFrame, buckets: int | None = None) -> None:
        """Replaces a table, and its copy."""
        old = self.changed.get(name) or self.base["tables"].get(name)
        buckets = buckets or (old["buckets"] if old else self.store.buckets)
        copies = [n for n in (name, COPIES.get(name)) if n]
        if len(copies) > 1:
            df = materialize(df, name)
        for n in copies:
            key = KEYS.get(n, "id" if "id" in df.columns else df.columns[0])
            self._set(n, df, self._write(n, df, key, buckets), key, buckets)

    def change(self, name: str, keys: DataFrame, by: Callable[[DataFrame], DataFrame], on: str | None = None) -> None:
        """Replaces the buckets that hold the rows of keys (column `on`, by default the table's key) by what `by` makes of
        their rows; new rows must have one of the keys. The buckets of another column's values are found by a scan of
        that column and the key."""
        entry = self._now(name)
        if entry is None:
            self.put(name, by(self.read(name)).select(*self.read(name).columns))
            return
        table, key, buckets = self.read(name), entry["key"], entry["buckets"]
        on = on or key
        if on == key:
            touched = keys.select(bucket(F.col(key), buckets).alias("b"))
        else:
            wanted = keys.select(F.col(on).alias("__on")).distinct()
            touched = table.select(key, on).join(wanted, F.col(on) == F.col("__on"), "left_semi").select(bucket(F.col(key), buckets).alias("b"))
        hit = [r["b"] for r in touched.distinct().collect()]  # at most the number of buckets
        if not hit:
            return
        rows = by(self.store._load(name, entry, hit)).select(*table.columns)
        copy = COPIES.get(name)
        rows = materialize(rows, name) if copy else rows
        files = {b: f for b, f in entry["files"].items() if int(b) not in hit} | self._write(name, rows, key, buckets)
        if copy:
            self._copy(copy, self.store._load(name, entry, hit), rows)
        self._set(name, table, files, key, buckets)

    def _copy(self, name: str, before: DataFrame, after: DataFrame) -> None:
        """Takes over into a copy how the rows of some buckets of the original have changed."""
        same = [c for c in before.columns if before.schema[c].dataType.simpleString() != "map"]
        digest = F.xxhash64(*same)
        old, new = before.withColumn("__d", digest), after.withColumn("__d", digest)
        gone = old.join(new.select("id", "__d"), ["id", "__d"], "left_anti").drop("__d")
        come = materialize(new.join(old.select("id", "__d"), ["id", "__d"], "left_anti").drop("__d"), name)
        gone = materialize(gone.select("id", KEYS[name]), f"{name}_gone")
        keys = gone.select(KEYS[name]).union(come.select(KEYS[name]))
        self.change(name, keys, lambda held: held.join(gone.select("id"), "id", "left_anti").select(*held.columns).unionByName(come.select(*held.columns)))

    def commit(self) -> int:
        """The new version; that of the base if nothing has changed or the batch was there before."""
        if self.repeated or not self.changed:
            return self.base["version"]
        self.store._fs.mkdirs(self.store._at("_log"))
        while True:
            batches = self.base["batches"] | ({self.batch[0]: self.batch[1]} if self.batch else {})
            new = {"version": self.base["version"] + 1, "tables": self.base["tables"] | self.changed, "batches": batches}
            if self.store._publish(new):
                self.base, self.changed = new, {}
                return new["version"]
            last = self.store.manifest()
            if stale := sorted(n for n in self.seen if last["tables"].get(n) != self.base["tables"].get(n)):
                raise Conflict(f"changed since version {self.base['version']}: {', '.join(stale)}")
            if self.batch and last["batches"].get(self.batch[0], -1) >= self.batch[1]:
                raise Conflict(f"batch {self.batch[1]} of {self.batch[0]} has been committed by another writer")
            self.base = last


def jdbc(spark: SparkSession, url: str, name: str, partition_column: str | None = None, bounds: tuple[int, int, int] | None = None, **options: str) -> DataFrame:
    """A database table; with a column and (low, high, parts) it is read in parallel ranges. The driver must be on the class path."""
    r = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if partition_column and bounds:
        r = r.options(partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(bounds[2]))
    return r.load()


@dataclass(frozen=True)
class Field:
    """A member of a request: its type (string, long, double, boolean or array<string>), whether it may be missing or null,
    and the least and largest value, or length of a string or array."""

    name: str
    type: str = "string"
    optional: bool = False
    least: float | None = None
    most: float | None = None


#: The kinds of JSON values that a type takes.
_KINDS = {"string": ("STRING",), "long": ("BIGINT", "INT", "SMALLINT", "TINYINT"), "double": ("BIGINT", "INT", "SMALLINT", "TINYINT", "FLOAT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array<string>": ("ARRAY",)}


def requests(lines: DataFrame, fields: Sequence[Field], column: str = "value") -> DataFrame:
    """Request bodies in JSON, a row for each line: the fields; `reasons`, what is wrong, in the order of fields; and
    `rejected`, the line, if anything is. The fields of a rejected line are null, and a line is rejected as a whole where
    it is not an object. A number is no text and a text no number; members that no field names are ignored."""
    body = F.try_parse_json(column)
    none, text = F.lit(None).cast("string"), F.lit
    values, reasons = [], []
    for f in fields:
        member = F.try_variant_get(body, f"$['{f.name}']", "variant")
        value = F.try_variant_get(member, "$", f.type)
        fits = F.array_contains(F.lit(list(_KINDS[f.type])), F.regexp_extract(F.schema_of_variant(member), "^[A-Z]+", 0)) & value.isNotNull()
        if f.type == "array<string>":
            items = F.try_variant_get(member, "$", "array<variant>")
            fits = fits & F.forall(items, lambda x: F.schema_of_variant(x) == "STRING")
        size = value if f.type in ("long", "double") else F.length(value) if f.type == "string" else F.size(value)
        low = size < F.lit(f.least) if f.least is not None else F.lit(False)
        high = size > F.lit(f.most) if f.most is not None else F.lit(False)
        missing = member.isNull() | F.is_variant_null(member)
        wrong = F.when(missing, none if f.optional else text(f"{f.name} is missing")).when(~F.coalesce(fits, F.lit(False)), text(f"{f.name} is not a {f.type}"))
        reasons.append(wrong.when(low | high, text(f"{f.name} is out of range")) if f.type != "boolean" else wrong)
        values.append(value.alias(f.name))
    object_ = F.coalesce(F.schema_of_variant(body).startswith("OBJECT"), F.lit(False))
    why = F.when(~object_, F.array(text("the body is not an object"))).otherwise(F.filter(F.array(*reasons), lambda r: r.isNotNull()))
    out = lines.withColumn("__why", why)
    good = F.size("__why") == 0
    return out.select(*(F.when(good, v).alias(f.name) for v, f in zip(values, fields, strict=True)), F.col("__why").alias("reasons"), F.when(~good, F.coalesce(F.col(column), text("null"))).alias("rejected"))
