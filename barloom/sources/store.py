"""Tables that are replaced or appended to as a whole: data first, then a manifest that names them.

A version of a table is a manifest: a small JSON file that lists folders of Parquet files, their rows, digests and ranges of keys, and the identity of what made them. Data are written to a folder of their own; only
when they are complete is the manifest put in place, under a temporary name and by a rename. A writer that dies before leaves the last version as it was, and a folder that no manifest names. Readers are pinned to
one manifest, whatever is written meanwhile. One writer at a time; readers need no lock.

Appends are idempotent: a batch that is known is not written again, and rows whose key is stored are left out, by an anti-join with the parts whose range of keys meets that of the new rows.
"""

from __future__ import annotations

import json
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.plans.tables import hadoop_path


class IdentityError(ValueError):
    """A table was made from something else than its reader expects."""


class Store:
    """A table in a folder. key: columns that no two rows share, for appends; the first of them should grow with time, as its range tells parts apart."""

    def __init__(self, spark: SparkSession, path: str, key: tuple[str, ...] = ()):
        self.spark, self.path, self.key = spark, path.rstrip("/"), tuple(key)

    # ---- manifests ----

    def _versions(self) -> list[int]:
        fs, at = hadoop_path(self.spark, f"{self.path}/manifests")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _text(self, path: str) -> str:
        fs, at = hadoop_path(self.spark, path)
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> dict | None:
        """A version's manifest, the last one's if none is named; None where nothing was written."""
        versions = self._versions()
        if version is None and not versions:
            return None
        if version is not None and version not in versions:
            raise ValueError(f"{self.path} has no version {version}")
        return json.loads(self._text(f"{self.path}/manifests/{versions[-1] if version is None else version:010d}.json"))

    def _commit(self, manifest: dict) -> int:
        version = manifest["version"]
        fs, final = hadoop_path(self.spark, f"{self.path}/manifests/{version:010d}.json")
        _, early = hadoop_path(self.spark, f"{self.path}/manifests/.{uuid4().hex}.tmp")
        stream = fs.create(early, True)
        stream.write(bytearray(json.dumps(manifest, indent=1).encode()))
        stream.close()
        if fs.exists(final) or not fs.rename(early, final):
            fs.delete(early, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another")
        return version

    # ---- writing ----

    def _part(self, df: DataFrame) -> dict:
        """Write a folder of data, and describe it by what is stored."""
        name = uuid4().hex
        df.write.parquet(f"{self.path}/data/{name}")
        stored = self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{name}")
        first = [F.min(self.key[0]).cast("string").alias("low"), F.max(self.key[0]).cast("string").alias("high")] if self.key else []
        # a sum of row hashes does not depend on their order
        digest = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38, 0)")).cast("string").alias("digest")
        told = stored.agg(F.count("*").alias("rows"), digest, *first).first().asDict()
        return {"name": name} | told

    def _check_identity(self, manifest: dict | None, identity: dict) -> None:
        wrong = {k: (manifest["identity"].get(k), v) for k, v in identity.items() if manifest["identity"].get(k) != v} if manifest else {}
        if wrong:
            raise IdentityError(f"{self.path}: " + "; ".join(f"{k} is {a!r}, not {b!r}" for k, (a, b) in sorted(wrong.items())))

    def save(self, df: DataFrame, identity: dict[str, str]) -> int:
        """Replace the table; the version's number. identity must say what the table was made from."""
        if not identity or not all(isinstance(v, str) and v for v in identity.values()):
            raise ValueError("identity needs values, which are text and not empty")
        last = self.manifest()
        part = self._part(df)
        return self._commit({"version": last["version"] + 1 if last else 0, "identity": identity, "schema": df.schema.jsonValue(), "key": list(self.key), "parts": [part], "batches": []})

    def append(self, df: DataFrame, batch: str, identity: dict[str, str] | None = None) -> int:
        """Add the rows whose key is not stored yet (of rows of one key, one); the version's number, the present one if the batch is known."""
        if not self.key:
            raise ValueError("appends need a key")
        last = self.manifest()
        self._check_identity(last, identity or {})
        if last and batch in last["batches"]:
            return last["version"]
        new = df.dropDuplicates(list(self.key))
        if last:
            if [c.lower() for c in df.columns] != [f["name"].lower() for f in last["schema"]["fields"]]:
                raise ValueError(f"{self.path}: columns differ")
            span = new.agg(F.min(self.key[0]).alias("low"), F.max(self.key[0]).alias("high")).first()
            kind = df.schema[self.key[0]].dataType.simpleString()
            meets = [p["name"] for p in last["parts"] if p["rows"] and span["low"] is not None and self.spark.range(1).select((F.lit(p["low"]).cast(kind) <= F.lit(span["high"])) & (F.lit(p["high"]).cast(kind) >= F.lit(span["low"]))).first()[0]]
            if meets:
                known = self._read(last, meets).select(*[F.col(c).alias(f"_key_{c}") for c in self.key])
                new = new.join(known, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in self.key], "left_anti")
        part = self._part(new)
        begun = last or {"version": -1, "identity": identity or {}, "schema": df.schema.jsonValue(), "key": list(self.key), "parts": [], "batches": []}
        return self._commit(begun | {"version": begun["version"] + 1, "parts": [*begun["parts"], part], "batches": [*begun["batches"], batch]})

    # ---- reading ----

    def _read(self, manifest: dict, names: list[str]) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def load(self, version: int | None = None, identity: dict[str, str] | None = None) -> DataFrame:
        """A version, the last one if none is named; an IdentityError if it was made from something else."""
        manifest = self.manifest(version)
        if manifest is None:
            raise ValueError(f"{self.path} is empty")
        self._check_identity(manifest, identity or {})
        return self._read(manifest, [p["name"] for p in manifest["parts"] if p["rows"]])

    def verify(self, version: int | None = None) -> bool:
        """Whether the data of a version are those that were written."""
        manifest = self.manifest(version)
        for p in manifest["parts"]:
            df = self._read(manifest, [p["name"]])
            told = df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38, 0)")).cast("string").alias("digest")).first()
            if (told["rows"], told["digest"]) != (p["rows"], p["digest"]):
                return False
        return True

    def orphans(self) -> list[str]:
        """Folders of data that no manifest names: what writers that died have left, or are writing."""
        fs, at = hadoop_path(self.spark, f"{self.path}/data")
        named = {p["name"] for v in self._versions() for p in self.manifest(v)["parts"]}
        return sorted(f.getPath().getName() for f in fs.listStatus(at) if f.getPath().getName() not in named) if fs.exists(at) else []

    def remove_orphans(self) -> list[str]:
        """Remove them; no writer may be at work."""
        left = self.orphans()
        for name in left:
            fs, at = hadoop_path(self.spark, f"{self.path}/data/{name}")
            fs.delete(at, True)
        return left
