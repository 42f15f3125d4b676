"""Commits over several tables: data in folders that are never changed, and manifests that say which of them make a version.

A commit writes new folders first and its manifest last, in one rename; a manifest with a higher number is the newer version.
A write that is cut short leaves folders that no manifest names, so readers see the old version of all tables; of two writers
that start from one version, the second fails. Row counts are observed while the data is written, without another pass.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerwind.functions.stored import stored
from ledgerwind.operators.store import fill_nulls

#: Folders of a table beyond which an append joins them into one.
MOST_FOLDERS = 50


class Conflict(RuntimeError):
    """Another commit has come first."""


class Store:
    """Tables under a root that all machines see."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, folder: str) -> list[str]:
        system, at = self._at(folder)
        return [s.getPath().getName() for s in system.listStatus(at)] if system.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.root}/manifests") if n.endswith(".json") and n[0] not in "._")

    def manifest(self, version: int | None = None) -> dict:
        """{"version": n, "tables": {name: {"schema", "folders", "rows"}}}; without a commit, version 0 and no tables."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if not version:
            return {"version": 0, "tables": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{version:08d}.json", wholetext=True).first()[0])

    def read(self, name: str, schema: StructType | None = None, version: int | None = None) -> DataFrame:
        """A table as of a version; one that isn't there yet is empty, with the schema given."""
        entry = self.manifest(version)["tables"].get(name)
        if entry is None:
            return self.spark.createDataFrame([], schema)
        kind = StructType.fromJson(entry["schema"])
        return self.spark.read.schema(kind).parquet(*entry["folders"]) if entry["folders"] else self.spark.createDataFrame([], kind)

    def _written(self, name: str, df: DataFrame) -> dict:
        folder, seen = f"{self.root}/data/{name}/{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
        return {"schema": df.schema.jsonValue(), "folders": [folder], "rows": seen.get["n"]}

    def commit(self, append: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None, base: int | None = None) -> dict[str, int]:
        """A new version with rows added to some tables and others made anew; returns the rows written by table.

        base is the version that the rows were made from, the newest one if it is left out.
        """
        now = self.manifest(base)
        tables, counts = dict(now["tables"]), {}
        for name, df in (replace or {}).items():
            tables[name] = self._written(name, df)
            counts[name] = tables[name]["rows"]
        for name, df in (append or {}).items():
            old = tables.get(name)
            if old and len(old["folders"]) >= MOST_FOLDERS:
                old = self._written(name, self.spark.read.schema(df.schema).parquet(*old["folders"]))
            new = self._written(name, df.select(*StructType.fromJson(old["schema"]).names) if old else df)
            counts[name] = new["rows"]
            tables[name] = new if old is None else {"schema": old["schema"], "folders": old["folders"] + new["folders"] * (new["rows"] > 0), "rows": old["rows"] + new["rows"]}
        self._publish({"version": now["version"] + 1, "tables": tables})
        return counts

    def _publish(self, manifest: dict) -> None:
        """Puts a manifest in place by a rename that fails if its number is taken."""
        jvm, path = self.spark.sparkContext._jvm, f"{self.root}/manifests/{manifest['version']:08d}.json"
        draft = f"{self.root}/manifests/.{uuid.uuid4().hex}"
        system, at = self._at(draft)
        out = system.create(at, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        hadoop = self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), hadoop).rename(at, target, options)
        except Exception as fault:
            system.delete(at, False)
            raise Conflict(f"version {manifest['version']} is there already") from fault

    def vacuum(self, keep: int = 1) -> int:
        """Removes all but the newest versions, and data that none of these names; no commit may be under way. Returns the folders removed."""
        found = self.versions()
        named = {f for v in found[-keep:] for t in self.manifest(v)["tables"].values() for f in t["folders"]}
        removed = 0
        for v in found[:-keep]:
            system, at = self._at(f"{self.root}/manifests/{v:08d}.json")
            system.delete(at, False)
        for name in self._names(f"{self.root}/data"):
            for folder in self._names(f"{self.root}/data/{name}"):
                if f"{self.root}/data/{name}/{folder}" not in named:
                    system, at = self._at(f"{self.root}/data/{name}/{folder}")
                    system.delete(at, True)
                    removed += 1
        return removed


def save_filings(store: Store, filings: DataFrame, lines: DataFrame, filers: DataFrame, filled: tuple[str, ...] = ("accepted_at",)) -> dict[str, int]:
    """Stores filings (source, accession, ...), their lines (source, accession, line_no, ...) and filers (source, cik, name) in one commit.

    Filings and lines that are there stay as they are, but that nulls of `filled` columns are filled in; a filer keeps its
    first name. Of rows that repeat a key in one load the one with the least other values counts. Returns the rows added by
    table, and as "filled" the filings that got a value. Filings are only written anew if there is something to fill.
    """
    keys = {"filings": ["source", "accession"], "lines": ["source", "accession", "line_no"], "filers": ["source", "cik"]}
    version = store.manifest()["version"]
    added, changed = {}, {}
    for name, new in (("filings", filings), ("lines", lines), ("filers", filers)):
        rest = [c for c in new.columns if c not in keys[name]]
        one = stored(new.groupBy(*keys[name]).agg(F.min(F.struct(*rest)).alias("r")).select(*keys[name], "r.*").select(*new.columns), name)
        old = store.read(name, new.schema, version)
        added[name] = one.join(old.select(*keys[name]), keys[name], "left_anti")
        if name == "filings":
            known = old.select(*keys[name], *(F.col(c).alias(f"_{c}") for c in filled)).join(one, keys[name])
            told = [F.col(f"_{c}").isNull() & F.col(c).isNotNull() for c in filled]
            gaps = stored(known.filter(_any(told)).select(*keys[name], *filled), "filled")
            n = gaps.count()
            if n:
                changed[name] = fill_nulls(old, gaps, keys[name], list(filled)).unionByName(added.pop(name))
    before = store.manifest(version)["tables"].get("filings", {"rows": 0})["rows"]
    counts = store.commit(added, changed, version)
    if "filings" in changed:
        counts["filings"] -= before
    return counts | {"filled": n}


def _any(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def fill_tickers(store: Store, symbols: DataFrame, table: str = "lines") -> int:
    """Fills null tickers of a table from symbols (issuer_cik, ticker, one row each); returns how many were filled."""
    version = store.manifest()["version"]
    rows = store.read(table, version=version)
    side = symbols.filter("ticker is not null").select("issuer_cik", F.col("ticker").alias("_symbol"))
    joined = rows.join(side, "issuer_cik", "left")
    filled = F.col("ticker").isNull() & F.col("_symbol").isNotNull()
    seen = Observation()
    out = joined.observe(seen, F.count_if(filled).alias("n")).withColumn("ticker", F.coalesce("ticker", "_symbol")).select(*rows.columns)
    store.commit(replace={table: out}, base=version)
    return seen.get["n"]


def delete(store: Store, gone: DataFrame, table: str, key: str, children: dict[str, list[str]], references: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> dict[str, int]:
    """Removes the rows of a table whose key stands in gone, those of its child tables with it, and mends references, in one commit.

    children names the columns by which a child table refers to the deleted rows; references maps a table and the rows that
    are gone to the table with its references mended. Returns the rows left by table.
    """
    version = store.manifest()["version"]
    columns = {table: [key], **children}
    out = {name: store.read(name, version=version).join(gone.select(*on).distinct(), on, "left_anti") for name, on in columns.items()}
    for name, mend in (references or {}).items():
        out[name] = mend(out.get(name, store.read(name, version=version)), gone)
    return store.commit(replace=out, base=version)
