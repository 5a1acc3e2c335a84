"""The catalog on disk: every table is a folder of whole versions in plain Parquet, the newest finished of which counts.

An append adds files to that version. Any other change writes the table anew through the functions of
`operators.maintenance`; Spark's `_SUCCESS` mark, written last, says that a version is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cinelake.operators import maintenance
from cinelake.schemas import DEFAULTS, KEYS, REFERENCES, TABLES

_VERSION = "version-"


class CatalogTables:
    """Reads and changes the tables below one root path, by one writer at a time.

    Whatever becomes of the writer of a new version, readers see the old rows until it is whole. Old versions stay.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self, name: str) -> dict[int, bool]:
        """The numbers of the table's versions, and whether each is whole."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        folder = path(f"{self.root}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return {int(p.getName().removeprefix(_VERSION)): fs.exists(path(p, "_SUCCESS")) for p in found if p.getName().startswith(_VERSION)}

    def _folder(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/{_VERSION}{version}"

    def read(self, name: str) -> DataFrame:
        """The table's rows; an unwritten table is empty."""
        version = max((v for v, whole in self.versions(name).items() if whole), default=None)
        if version is None:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(self._folder(name, version))

    def conform(self, name: str, df: DataFrame, insert: bool = True) -> DataFrame:
        """Columns in table order and type; missing ones are null, or for new rows the column's default, as are their nulls."""
        out = []
        defaults = DEFAULTS.get(name, {}) if insert else {}
        for field in self.spark.createDataFrame([], TABLES[name]).schema.fields:
            column = F.col(field.name) if field.name in df.columns else F.lit(None)
            if field.name in defaults:
                column = F.coalesce(column, F.lit(defaults[field.name]))
            out.append(column.cast(field.dataType).alias(field.name))
        return df.select(*out)

    def _write(self, name: str, df: DataFrame) -> None:
        version = max(self.versions(name), default=0) + 1
        self.conform(name, df, insert=False).write.parquet(self._folder(name, version))

    def replace_all(self, name: str, df: DataFrame) -> None:
        """Write all rows anew."""
        self._write(name, self.conform(name, df))

    def append(self, name: str, rows: DataFrame) -> None:
        """Add rows with new keys; a clash raises. Nothing happens for no rows. Existing files stay as they are."""
        if rows.isEmpty():
            return
        rows = self.conform(name, rows)
        clash = maintenance.key_conflicts(self.read(name), rows, KEYS[name]).limit(1).collect()
        if clash:
            raise maintenance.KeyConflict(f"key {clash[0].asDict()} cannot be appended to {name}")
        version = max((v for v, whole in self.versions(name).items() if whole), default=None)
        if version is None:
            self._write(name, rows)
        else:
            rows.write.mode("append").parquet(self._folder(name, version))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Replace rows by key, or add them; a repeated key raises `KeyConflict`."""
        self._write(name, maintenance.upsert_replace(self.read(name), self.conform(name, rows), KEYS[name]))

    def merge(self, name: str, rows: DataFrame) -> None:
        """Values that are given win; rows with new keys are added with the defaults. A repeated key raises `KeyConflict`."""
        keys, old = list(KEYS[name]), self.read(name)
        given = maintenance.latest(rows, keys, None)
        known = maintenance.upsert_merge(old, given.join(old.select(*keys), keys, "left_semi"), keys)
        self._write(name, known.unionByName(self.conform(name, given.join(old.select(*keys), keys, "left_anti"))))

    def insert_if_absent(self, name: str, rows: DataFrame) -> None:
        """Append the rows whose keys are new."""
        self.append(name, self.conform(name, rows).join(self.read(name).select(*KEYS[name]), list(KEYS[name]), "left_anti"))

    def update(self, name: str, patch: DataFrame) -> int:
        """Patch rows by key, where null clears; returns how many were touched. A repeated key raises `KeyConflict`."""
        keys, old = list(KEYS[name]), self.read(name)
        allowed = maintenance.UPDATABLE.get(name, [f for f in old.columns if f not in keys])
        bad = sorted(set(patch.columns) - set(keys) - set(allowed))
        if bad:
            raise ValueError(f"Disallowed column(s) for {name}: {bad}")
        touched = maintenance.affected_rows(old, patch, keys).first()["affected"]
        if touched:
            self._write(name, maintenance.keyed_update(old, patch, keys, allowed))
        return touched

    def delete(self, name: str, keys: DataFrame) -> None:
        self._write(name, maintenance.keyed_delete(self.read(name), keys, [k for k in KEYS[name] if k in keys.columns]))

    def rejects(self, name: str) -> DataFrame:
        """Rows of the table whose references do not resolve, with the column at fault."""
        table, out = self.read(name), None
        for column, (parent, key) in REFERENCES.get(name, {}).items():
            bad = maintenance.orphans(table, column, self.read(parent), key).withColumn("reject_reason", F.lit(f"{column} not in {parent}"))
            out = bad if out is None else out.unionByName(bad)
        return table.limit(0).withColumn("reject_reason", F.lit("")) if out is None else out
