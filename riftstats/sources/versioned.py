"""Tables whose partitions are written anew one by one and switched together.

A version stages only the partitions that it touches, in a folder of its own; then
the table's pointer, one small file, is replaced by a rename. Until then readers see
the version before, whole, and a job that stopped in between leaves a folder that
nothing refers to. The pointer names the folders of each partition, so reading
neither lists folders nor takes values from their names: partition columns stay
plain columns, and only the names of partitions are made from them.

One writer at a time. A label (the number of a batch or run) that isn't above the
last one has been applied already: applying it again changes nothing.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.merging import upserted

#: Folders of a partition from which it is rewritten as one when it is appended to.
MOST_FOLDERS = 8
IN_PART, NO_VALUE = "in_part", "none"


def part_name(value: str | None) -> str:
    """The name of the partition of a value, as part_names() makes it."""
    return NO_VALUE if value is None else "k" + re.sub("[^A-Za-z0-9.-]", "_", value)


def part_names(value: Column) -> Column:
    """Values that differ in other characters than these share a partition."""
    return F.coalesce(F.concat(F.lit("k"), F.regexp_replace(value.cast("string"), "[^A-Za-z0-9.-]", "_")), F.lit(NO_VALUE))


def fingerprints(rows: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """Of each partition the number of its rows and sums over two 64-bit hashes of
    each row, which tell other rows in any order, repeats included (by 128 bits),
    without moving a row. A null and its absence hash alike, so nulls are marked."""
    values = [F.struct(*[F.col(c) for c in columns]), F.struct(*[F.col(c).isNull() for c in columns])]
    halves = []
    for hashed in (F.xxhash64(*values), F.xxhash64(F.lit("again"), *values)):
        # in halves, so that sums of any number of rows fit
        halves += [hashed.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(hashed, 32)]
    return {r[0]: tuple(r)[1:] for r in rows.groupBy(IN_PART).agg(F.count("*"), *[F.sum(h) for h in halves]).collect()}


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, part: Column | None = None, ddl: str | None = None, most_folders: int = MOST_FOLDERS, codec: str = "snappy"):
        """part: what rows are partitioned by (all are one partition without it);
        ddl: the columns of a table that hasn't been written yet; codec: how its files
        are compressed."""
        self.spark, self.path, self.ddl, self.most_folders, self.codec = spark, path.rstrip("/"), ddl, most_folders, codec
        self.part = part_names(F.lit("all") if part is None else part)
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._text = jvm.org.apache.commons.io.IOUtils

    def _hadoop(self, path: str):  # noqa: ANN202
        return self._fs.Path(path)

    def _files(self):  # noqa: ANN202
        return self._hadoop(self.path).getFileSystem(self._conf)

    def pointer(self) -> dict:
        """version, label, schema and the folders of each partition."""
        at = self._hadoop(f"{self.path}/CURRENT")
        if not self._files().exists(at):
            return {"version": 0, "label": -1, "schema": None, "parts": {}}
        source = self._files().open(at)
        try:
            return json.loads(self._text.toString(source, "UTF-8"))
        finally:
            source.close()

    def _switch(self, pointer: dict) -> None:
        staged = f"{self.path}/CURRENT.{uuid.uuid4().hex}"
        out = self._files().create(self._hadoop(staged), True)
        out.write(bytearray(json.dumps(pointer).encode()))
        out.close()
        how = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 1)
        how[0] = self._fs.Options.Rename.OVERWRITE
        context = self._fs.FileContext.getFileContext(self._hadoop(self.path).toUri(), self._conf)
        context.rename(self._hadoop(staged), self._hadoop(f"{self.path}/CURRENT"), how)

    def _stage(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Writes rows to a new folder; its name and the partitions that it has."""
        folder = f"v-{uuid.uuid4().hex}"
        (rows if IN_PART in rows.columns else rows.withColumn(IN_PART, self.part)).write.partitionBy(IN_PART).option("compression", self.codec).parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._files().listStatus(self._hadoop(f"{self.path}/{folder}"))]
        return folder, sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{IN_PART}="))

    def _read(self, folders: list[str], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def exists(self) -> bool:
        return self.pointer()["version"] > 0

    def folders(self, names: list[str] | None = None) -> list[str]:
        """Folders of some partitions, of all if none are named."""
        parts = self.pointer()["parts"]
        return [f for name in (parts if names is None else names) for f in parts.get(name, [])]

    def read(self, names: list[str] | None = None) -> DataFrame:
        """The current version, or some of its partitions."""
        got = self.pointer()
        if got["schema"] is None:
            if self.ddl is None:
                raise ValueError(f"{self.path} hasn't been written yet")
            return self.spark.createDataFrame([], self.ddl)
        return self._read(self.folders(names), StructType.fromJson(got["schema"]))

    def names_in(self, rows: DataFrame) -> list[str]:
        """The partitions that rows belong to (a few names a table)."""
        return [r[0] for r in rows.select(self.part).distinct().collect()]

    def replace(self, rows: DataFrame, label: int | None = None) -> None:
        """The partitions that rows belong to hold these rows only, others stay."""
        self._apply(rows, label, lambda old, new: new)

    def append(self, rows: DataFrame, label: int | None = None) -> None:
        """Adds rows. A partition of too many folders is rewritten as one first. Rows
        may carry the name of their partition as `in_part`, which isn't stored: where many
        come of one row, it is made once."""
        self._apply(rows, label, lambda old, new: old + new)

    def _apply(self, rows: DataFrame, label: int | None, joined) -> None:  # noqa: ANN001
        was = self.pointer()
        if label is not None and label <= was["label"]:
            return
        folder, names = self._stage(rows)
        schema = rows.drop(IN_PART).schema
        parts = dict(was["parts"])
        for name in names:
            parts[name] = joined(parts.get(name, []), [f"{folder}/{IN_PART}={name}"])
        full = [n for n in names if len(parts[n]) > self.most_folders]
        if full:
            packed, _ = self._stage(self._read([f for n in full for f in parts[n]], schema))
            for name in full:
                parts[name] = [f"{packed}/{IN_PART}={name}"]
        self._switch({"version": was["version"] + 1, "label": was["label"] if label is None else label, "schema": schema.jsonValue(), "parts": parts})

    def merge(self, incoming: DataFrame, keys: list[str], newest: str | None = None) -> dict[str, int]:
        """Upserts incoming rows by keys, on which the partition has to depend alone.
        Read and staged are the touched partitions; switched are those in which a row
        was inserted or updated, so the same rows once more change nothing. Returns
        how many rows of the touched partitions were inserted, updated and so on."""
        was = self.pointer()
        current = self.read(self.names_in(incoming)) if was["schema"] or self.ddl else incoming.where("false")
        merged = upserted(current.select(*incoming.columns), incoming, keys, newest)
        folder, names = self._stage(merged)
        if not names:
            return {}
        staged = self.spark.read.schema(StructType([*merged.schema.fields, StructField(IN_PART, StringType())])).parquet(f"{self.path}/{folder}")
        counts = staged.groupBy(IN_PART, "change").count().collect()
        changed = {r[IN_PART] for r in counts if r.change in ("inserted", "updated")}
        if changed:
            parts = was["parts"] | {n: [f"{folder}/{IN_PART}={n}"] for n in sorted(changed)}
            self._switch({"version": was["version"] + 1, "label": was["label"], "schema": merged.drop("change").schema.jsonValue(), "parts": parts})
        out: dict[str, int] = {}
        for r in counts:
            out[r.change] = out.get(r.change, 0) + r["count"]
        return out

    def fold(self, rows: DataFrame, merged: Callable[[DataFrame], DataFrame], label: int | None = None) -> None:
        """Replaces the partitions that rows belong to by merged(what they hold, with
        rows behind it), which stays in these partitions: counts that add up."""
        was = self.pointer()
        if label is not None and label <= was["label"]:
            return
        if not was["schema"]:
            return self.replace(merged(rows), label)
        # staged once, as what rows derive from may be much larger than they are
        folder, names = self._stage(rows)
        if not names:
            return self.replace(rows, label)
        new = self._read([f"{folder}/{IN_PART}={n}" for n in names], rows.schema)
        self.replace(merged(self.read(names).select(*rows.columns).unionByName(new)), label)

    def rewrite(self, rows: DataFrame) -> list[str]:
        """As replace, but only the partitions whose rows differ are switched; their
        names."""
        was = self.pointer()
        folder, names = self._stage(rows)
        if not names:
            return []
        schema = StructType([*rows.schema.fields, StructField(IN_PART, StringType())])
        staged = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        changed = names
        if was["schema"] is not None:
            old = self.read(names).select(*rows.columns).withColumn(IN_PART, self.part)
            now, then = (fingerprints(df, rows.columns) for df in (staged, old))
            changed = sorted(n for n in now if now[n] != then.get(n))
        if changed:
            parts = was["parts"] | {n: [f"{folder}/{IN_PART}={n}"] for n in changed}
            self._switch({"version": was["version"] + 1, "label": was["label"], "schema": rows.schema.jsonValue(), "parts": parts})
        return changed

    def vacuum(self) -> int:
        """Removes folders that the pointer doesn't name (while nobody reads an older
        version or writes a new one); returns how many."""
        kept = {f.split("/", 1)[0] for f in self.folders()}
        gone = [s.getPath() for s in self._files().listStatus(self._hadoop(self.path)) if s.getPath().getName().startswith("v-") and s.getPath().getName() not in kept]
        for path in gone:
            self._files().delete(path, True)
        return len(gone)
