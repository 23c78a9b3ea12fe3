"""Tables as versioned Parquet snapshots, and the store's changes as DataFrame rewrites.

A table is a folder of versions v1, v2, ... and the newest complete one is its content. A change reads one version
and writes the next, so nothing is overwritten while it is read, and a failed write leaves the old version in place.
A table with a key is dealt into parts by the key's hash: a version then holds only the parts that it changes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ChangedTableError(RuntimeError):
    """Another writer was faster."""


class Table:
    """``sorted_by`` sorts the files of a version by a column, so that reads of a few of its values skip the rest.

    With ``key``, rows are dealt into ``parts`` by a hash of that column. Folders of a version are named for what they are to a part: ``of16=3`` holds its rows,
    ``plus16=3`` more rows of it, ``gone16=3`` says that its older rows no longer count. So ``change`` rewrites the parts of some keys only, ``append`` none, and after
    ``merge_after`` versions the next change writes all parts anew. Choose ``parts`` so that one is a few GB; another number takes effect with the next change, which then writes
    everything.

    A new version must follow from what was read last: if another writer has made a version or added rows since, or is about to make the same version, the writer is refused and
    the table left as it is, so that no rows are lost in silence. Read again, and make the change anew.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, sorted_by: str | None = None, *, key: str | None = None, parts: int = 16, merge_after: int = 100) -> None:
        self.spark, self.path, self.schema, self.sorted_by = spark, path.rstrip("/"), schema, sorted_by
        self.key, self.parts, self.merge_after = key, parts, merge_after
        self.seen: str | None = None

    def _path(self, name: str = "") -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self) -> object:
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _listed(self, name: str = "") -> list[str]:
        folder, fs = self._path(name), self._fs()
        return [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []

    def _versions(self) -> Iterator[tuple[int, list[str]]]:
        """The complete versions and the names in their folders, the newest first."""
        for n in sorted((int(n[1:]) for n in self._listed() if n[:1] == "v" and n[1:].isdigit()), reverse=True):
            names = self._listed(f"v{n}")
            if "_SUCCESS" in names:
                yield n, names

    def _newest(self) -> int:
        return next((n for n, _ in self._versions()), 0)

    def stamp(self) -> str:
        """Changes with every write and every append."""
        return next((f"{n}-{len(names)}" for n, names in self._versions()), "")

    def _places(self) -> tuple[dict[int, list[str]], list[str], int, int]:
        """The folders of each part, folders that aren't dealt into parts, into how many parts the others are, and how many versions these stand in."""
        found, whole, closed, dealt, n_versions = {}, [], set(), 0, 0
        for n, names in self._versions():
            n_versions += 1
            marks = [m for m in (re.fullmatch(r"(of|plus|gone)(\d+)=(\d+)", x) for x in names) if m]
            if not marks:
                whole = [f"{self.path}/v{n}"]
                break
            dealt = dealt or int(marks[0][2])
            for m in marks:
                if m[1] != "gone" and int(m[3]) not in closed:
                    found.setdefault(int(m[3]), []).append(f"{self.path}/v{n}/{m[0]}")
            closed |= {int(m[3]) for m in marks if m[1] == "gone"}
            if len(closed) == dealt:
                break
        return found, whole, dealt, n_versions

    def _rows(self, folders: list[str]) -> DataFrame:
        return with_defaults(self.spark.read.parquet(*folders), self.schema) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        self.seen = self.stamp()
        found, whole, _, _ = self._places()
        return self._rows([f for p in sorted(found) for f in found[p]] + whole)

    def _shaped(self, df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])

    def _part(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast(self.schema[self.key].dataType)), F.lit(self.parts)).cast("int")

    def _commit(self, df: DataFrame, gone: Iterable[int], kind: str = "of") -> None:
        """The next version: rows of ``df``, in place of what the parts in ``gone`` held. It counts from the moment Spark marks it as complete."""
        number, fs = self._newest() + 1, self._fs()
        claim = self._path(f"claim-v{number}")
        fs.mkdirs(claim.getParent())
        if not fs.createNewFile(claim):
            raise ChangedTableError(f"another writer makes version {number} of {self.path}; if it is gone, delete {claim.toString()}")
        try:
            if self.seen is not None and self.seen != self.stamp():
                raise ChangedTableError(f"{self.path} has changed since it was read")
            rows, target = self._shaped(df), f"{self.path}/v{number}"
            if self.key is None:
                rows = rows.repartitionByRange(self.sorted_by).sortWithinPartitions(self.sorted_by) if self.sorted_by else rows
                rows.write.mode("overwrite").parquet(target)
            else:
                fs.delete(self._path(f"v{number}"), True)  # what a writer that broke off has left
                for p in gone:
                    fs.mkdirs(self._path(f"v{number}/gone{self.parts}={p}"))
                column = f"{kind}{self.parts}"
                rows = rows.withColumn(column, self._part(F.col(self.key))).hint("rebalance", column)
                rows = rows.sortWithinPartitions(column, self.sorted_by) if self.sorted_by else rows
                rows.write.mode("append").partitionBy(column).parquet(target)
            self.seen = self.stamp()
        finally:
            fs.delete(claim, False)

    def write(self, df: DataFrame) -> None:
        """The whole content."""
        self._commit(df, range(self.parts))

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """``make`` gets the rows of all parts that hold a key of ``keys`` (its first column) and gives what they shall hold, rows of the same parts; other parts stay as they are.

        Without a key of the table, or where its parts aren't as they should be, it gets and gives all rows. No keys, no change.
        """
        self.seen = self.stamp()
        found, whole, dealt, n_versions = self._places()
        if self.key is None or whole or dealt != self.parts or n_versions > self.merge_after:
            return self.write(make(self._rows([f for p in sorted(found) for f in found[p]] + whole)))
        touched = [r[0] for r in keys.select(self._part(F.col(keys.columns[0]))).distinct().collect()]  # numbers of parts
        if touched:
            self._commit(make(self._rows([f for p in touched for f in found.get(p, [])])), touched)

    def append(self, df: DataFrame) -> None:
        """Rows beside those of the newest version, as files of their own: nothing is read or rewritten. Without a key of the table, writers don't meet."""
        if self.key is None:
            self._shaped(df).write.mode("append").parquet(f"{self.path}/v{self._newest() or 1}")
        elif not df.isEmpty():
            self._commit(df, (), "plus")

    def forget(self) -> int:
        """Delete the versions that hold nothing of the content any more, and say how many; nobody may be reading them still."""
        needed, fs = self._places()[3], self._fs()
        old = [n for n, _ in self._versions()][needed:]
        for n in old:
            fs.delete(self._path(f"v{n}"), True)
        return len(old)


def with_defaults(df: DataFrame, schema: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns that an older table lacks, with their defaults."""
    defaults = {"workspace_id": "default", "workspace": "default"} | (defaults or {})
    have = set(df.columns)
    return df.select(*[F.col(f.name) if f.name in have else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])


def upsert(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """``new`` replaces the rows of ``base`` that have its keys."""
    return base.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_children(base: DataFrame, new: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """The rows of the given parents give way to ``new``."""
    return base.join(parents.select(F.col(parents.columns[0]).alias(parent)).distinct(), parent, "left_anti").unionByName(new, allowMissingColumns=True)


def add_edges_if_absent(edges: DataFrame, new: DataFrame) -> DataFrame:
    """New edges that stand in neither direction with the same type yet; loops are refused; of equal new ones the first by seq stays."""
    low, high = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    have = edges.select(low.alias("low"), high.alias("high"), "relation_type").distinct()
    fresh = new.where("source_id != target_id").withColumn("low", low).withColumn("high", high)
    first = fresh.groupBy("low", "high", "relation_type").agg(F.min_by(F.struct(*new.columns), "seq").alias("row"))
    return first.join(have, ["low", "high", "relation_type"], "left_anti").select("row.*")


def without_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti")


def without_members(df: DataFrame, gone: DataFrame, column: str, member: str | None = None, key: str = "id") -> DataFrame:
    """Without those members of an array column (by their field ``member``, if they are structs) that the one column of ``gone`` lists; the rest keeps its order.

    Only rows that hold a listed member are rebuilt; ``key`` is unique, and neither side need be small.
    """
    inside = F.col("x") if member is None else F.col(f"x.{member}")
    held = df.select(key, F.explode(column).alias("x")).select(key, inside.alias("m"))
    hit = held.join(gone.select(F.col(gone.columns[0]).alias("m")).distinct(), "m", "left_semi").groupBy(key).agg(F.collect_set("m").alias("__gone"))  # a row's own members
    rest = F.filter(column, lambda x: ~F.coalesce(F.array_contains("__gone", x if member is None else x[member]), F.lit(False)))
    return df.join(hit, key, "left").withColumn(column, F.when(F.col("__gone").isNull(), F.col(column)).otherwise(rest)).drop("__gone")


def only_ids(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return df.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_semi")


def moved_to_default(df: DataFrame, workspace: str, column: str = "workspace_id") -> DataFrame:
    """Rows of a deleted workspace go to the default one, which itself cannot be deleted."""
    if workspace == "default":
        raise ValueError("the default workspace cannot be deleted")
    return df.withColumn(column, F.when(F.col(column) == workspace, F.lit("default")).otherwise(F.col(column)))


def merged_lists(a: Column, b: Column) -> Column:
    """The union of two lists in order of first occurrence."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def merge_concepts(base: DataFrame, new: DataFrame) -> DataFrame:
    """Concepts of ``base`` with those of ``new`` of the same id merged in (one row for each id on either side).

    Sources, tags and mechanisms are united, an empty summary is filled, relations whose (target, type) is new are added unless
    they lead to the concept itself, and the workspace is adopted if the old one is the default. The rest keeps its old value.
    """
    n = new.select("id", *[F.col(c).alias(f"n_{c}") for c in ("sources", "tags", "mechanisms", "summary", "relations", "workspace")])
    known = F.transform("relations", lambda r: F.concat_ws("\x00", r["target"], r["type"]))
    added = F.filter("n_relations", lambda r: ~F.array_contains(F.coalesce(known, F.array().cast("array<string>")), F.concat_ws("\x00", r["target"], r["type"])) & (r["target"] != F.col("id")))
    joined = base.join(n, "id", "left")
    have = F.col("n_workspace").isNotNull()
    return joined.select(
        *[
            (
                merged_lists(F.col(c), F.col(f"n_{c}"))
                if c in ("sources", "tags", "mechanisms")
                else F.when(have & (F.coalesce("summary", F.lit("")) == ""), F.col("n_summary")).otherwise(F.col("summary"))
                if c == "summary"
                else F.when(have, F.concat(F.coalesce("relations", F.expr("array()").cast(base.schema["relations"].dataType)), added)).otherwise(F.col("relations"))
                if c == "relations"
                else F.when(have & (F.col("workspace") == "default"), F.col("n_workspace")).otherwise(F.col("workspace"))
                if c == "workspace"
                else F.col(c)
            ).alias(c)
            for c in base.columns
        ]
    )
