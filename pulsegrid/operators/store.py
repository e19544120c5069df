"""Feature store: versions of a table as column groups under a manifest.

A group is a Parquet folder with the keys and some of the columns. A manifest names the
columns' groups and is the version: it appears by one rename, so whoever reads sees the old
version or the new one, and a commit that dies leaves nothing but files that no manifest names.
New values of some columns are written as a group of their own; what is read joins the groups
of the columns that are asked for. Arrays of samples may be kept as 16-bit numbers with a gain.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GAIN = "gain"


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the non-null values of new's columns; keys that only new has are added."""
    both = old.alias("o").join(new.alias("n"), keys, "full_outer")
    later = set(new.columns)
    value = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if c in later else F.col(f"o.{c}")
    names = [*old.columns, *(c for c in new.columns if c not in old.columns)]
    return both.select(*(F.col(c) if c in keys else (value(c) if c in old.columns else F.col(f"n.{c}")).alias(c) for c in names))


def write(features: DataFrame, path: str, source: str = "db") -> None:
    features.write.mode("overwrite").partitionBy(source).parquet(path)


def quantised(samples: Column, gain: float, name: str) -> Column:
    """An array of numbers as 16-bit steps of 1 / gain, cut to their range; the gain goes along
    in the column's metadata."""
    step = lambda x: F.greatest(F.least(F.round(x * gain), F.lit(32767.0)), F.lit(-32768.0)).cast("short")
    return F.transform(samples, step).alias(name, metadata={GAIN: gain})


def restored(df: DataFrame) -> DataFrame:
    """df with its quantised columns as doubles again."""

    def doubles(name: str, gain: float) -> Column:
        return F.transform(name, lambda x: x.cast("double") / gain)

    gains = {f.name: f.metadata[GAIN] for f in df.schema.fields if GAIN in f.metadata}
    return df.withColumns({c: doubles(c, g) for c, g in gains.items()}) if gains else df


class VersionConflict(RuntimeError):
    """Someone else has committed the version in the meantime."""


class Store:
    """Versions of a table of features in a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/versions")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted(int(n.split(".")[0]) for n in names if n[0].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """{keys, groups: {column: folder}, schema} of a version, by default the latest."""
        held = self.versions()
        if not held or version is not None and version not in held:
            raise LookupError(f"no version {version if version is not None else ''} in {self.path}; there are {held}")
        name = f"{self.path}/versions/{(held[-1] if version is None else version):08d}.json"
        return json.loads("\n".join(r[0] for r in self.spark.read.text(name, wholetext=True).collect()))  # a manifest: a line a column

    def _publish(self, version: int, manifest: dict) -> int:
        final, draft = self._path(f"{self.path}/versions/{version:08d}.json"), self._path(f"{self.path}/versions/_{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise VersionConflict(f"version {version} of {self.path} is there already")
        return version

    def _group(self, df: DataFrame) -> str:
        name = f"groups/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        return name

    def create(self, df: DataFrame, keys: list[str]) -> int:
        """The first version, with all columns in one group. Keys are unique and not null."""
        self._unique(df, keys)
        group = self._group(df)
        return self._publish(1, {"keys": keys, "groups": {c: group for c in df.columns if c not in keys}, "order": df.columns})

    def _unique(self, df: DataFrame, keys: list[str]) -> None:
        bad = df.groupBy(*keys).agg(F.count("*").alias("n")).where(" or ".join(["n > 1", *(f"`{k}` is null" for k in keys)])).head(1)
        if bad:
            raise ValueError(f"keys that are null or not unique: {bad[0]}")

    def read(self, columns: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Keys and columns (all, if none are given) of a version; only the groups that hold them are read."""
        found = self.manifest(version)
        wanted = [c for c in found["order"] if c not in found["keys"]] if columns is None else columns
        missing = [c for c in wanted if c not in found["groups"]]
        if missing:
            raise LookupError(f"no column {missing} in {self.path}")
        of: dict[str, list[str]] = {}
        for c in wanted:
            of.setdefault(found["groups"][c], []).append(c)
        base = next(iter(found["groups"].values())) if not of else next(iter(of))
        table = self.spark.read.parquet(f"{self.path}/{base}").select(*found["keys"], *of.get(base, []))
        for group, own in of.items():
            if group != base:
                table = table.join(self.spark.read.parquet(f"{self.path}/{group}").select(*found["keys"], *own), found["keys"])
        return restored(table.select(*found["keys"], *wanted))

    def update(self, new: DataFrame, version: int | None = None) -> int:
        """A version in which the columns of `new` have its non-null values, and the old ones where
        it has none; all other columns stay where they are. ValueError for keys that the store
        does not have. `version`: the one that new was made from, by default the latest."""
        at = self.versions()[-1] if version is None else version
        found = self.manifest(at)
        keys, own = found["keys"], [c for c in new.columns if c not in found["keys"]]
        self._unique(new, keys)
        known = [c for c in own if c in found["groups"]]
        old = self.read(known, at)
        strange = new.join(old.select(*keys), keys, "left_anti").head(1)
        if strange:
            raise ValueError(f"the store has no row for {strange[0]}")
        group = self._group(upsert(old, new, keys).select(*keys, *own))
        order = [*found["order"], *(c for c in own if c not in found["groups"])]
        return self._publish(at + 1, found | {"groups": found["groups"] | dict.fromkeys(own, group), "order": order})

    def sweep(self) -> list[str]:
        """Delete the groups that no version names; call it when no commit is on its way."""
        named = {g for v in self.versions() for g in self.manifest(v)["groups"].values()}
        folder = self._path(f"{self.path}/groups")
        loose = [f"groups/{f.getPath().getName()}" for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        loose = [g for g in loose if g not in named]
        for g in loose:
            self._fs.delete(self._path(f"{self.path}/{g}"), True)
        return loose
