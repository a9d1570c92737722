"""Networks kept as a folder of Parquet tables with a manifest, written last, of their versions and digests."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..streaming.sink import Store, canonical, digest

VERSION, MANIFEST = 1, "_network.json"


def save(tables: dict[str, DataFrame], path: str, metadata: dict | None = None) -> dict:
    """Writes the tables beside the path and moves them there when all are whole; an existing network is replaced by the move."""
    spark = next(iter(tables.values())).sparkSession
    folder, _, name = path.rstrip("/").rpartition("/")
    store, temporary = Store(spark, folder), f"_network-{uuid.uuid4().hex}"
    said = {"version": VERSION, "metadata": canonical(metadata or {}), "tables": {}}
    for t, df in sorted(tables.items()):
        df.write.parquet(f"{folder}/{temporary}/{t}")
        written = spark.read.schema(df.schema).parquet(f"{folder}/{temporary}/{t}")
        said["tables"][t] = {"schema": json.loads(df.schema.json()), "rows": written.count(), "digest": digest(written)}
    store.write(f"{temporary}/{MANIFEST}", json.dumps(said, sort_keys=True))
    if store.exists(name):
        old = f"_old-{uuid.uuid4().hex}"
        store.move(name, old)
        store.move(temporary, name)
        store.remove(old)
    else:
        store.move(temporary, name)
    return said


def manifest(spark: SparkSession, path: str) -> dict:
    store = Store(spark, path)
    if not store.exists(MANIFEST):
        raise ValueError(f"{path}: no network here")
    said = json.loads(store.read(MANIFEST))
    if said.get("version") != VERSION:
        raise ValueError(f"{path}: written by version {said.get('version')}, this is version {VERSION}")
    return said


def load(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """The tables by name, read when they are used; verify: against their digests."""
    from pyspark.sql.types import StructType

    said, out = manifest(spark, path), {}
    for t, entry in said["tables"].items():
        df = spark.read.schema(StructType.fromJson(entry["schema"])).parquet(f"{path}/{t}")
        if verify and digest(df) != entry["digest"]:
            raise ValueError(f"{path}: table {t} is damaged")
        out[t] = df
    return out


def content_digest(tables: dict[str, DataFrame]) -> str:
    """One digest of all tables, the same for equal contents in any order of rows."""
    import hashlib

    return hashlib.sha256(json.dumps({t: digest(df) for t, df in sorted(tables.items())}, sort_keys=True).encode()).hexdigest()
