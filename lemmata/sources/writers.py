"""Sinks: published tables, index directories with a manifest, appends and the checks after writing."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def publish(df: DataFrame, path: str, config: str, rows_per_file: int = 1_000_000) -> None:
    """Zstandard Parquet by configuration, with a bound on the rows of a file (K1)."""
    df.write.mode("overwrite").partitionBy(config).option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)


def counted(df: DataFrame, config: str) -> dict[str, int]:
    return {r[config]: r["count"] for r in df.groupBy(config).count().collect()}


def gate(built: dict[str, int], audited: dict[str, int]) -> None:
    """Built counts must be the audited ones (K8)."""
    if built != audited:
        raise ValueError(f"counts differ: built {built}, audited {audited}")


def validate(spark: SparkSession, path: str, config: str, expected: dict[str, int]) -> None:
    """Read what was written again and compare its counts (K7)."""
    gate(counted(spark.read.parquet(path), config), expected)


_MANIFEST = "kind string, version int, counts string, folder string, written double"


def save_index(tables: dict[str, DataFrame], path: str, kind: str, version: int = 1) -> None:
    """Tables of an index in a folder of their own and, last, a manifest row beside the older ones (K2, K4).

    Readers go by the newest manifest row, so a crash while writing leaves the index as it was.
    """
    folder, counts = uuid.uuid4().hex, {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{folder}/{name}").count()
    spark = next(iter(tables.values())).sparkSession
    row = (kind, version, json.dumps(counts, sort_keys=True), folder, time.time())
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


def _newest(spark: SparkSession, path: str):
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest").orderBy(F.desc("written")).first()


def load_index(spark: SparkSession, path: str, kind: str, version: int = 1) -> dict[str, DataFrame]:
    """The tables of the newest index, after every check: kind, version and row counts."""
    m = _newest(spark, path)
    if m is None or m["kind"] != kind or m["version"] != version:
        raise ValueError(f"not an index of kind {kind!r}, version {version}")
    tables = {name: spark.read.parquet(f"{path}/{m['folder']}/{name}") for name in json.loads(m["counts"])}
    gate({n: t.count() for n, t in tables.items()}, json.loads(m["counts"]))
    return tables


def fresh(spark: SparkSession, path: str, docs: int) -> bool:
    """Whether the newest index was built from as many documents (K5)."""
    m = _newest(spark, path)
    return m is not None and json.loads(m["counts"]).get("docs") == docs


def append(df: DataFrame, path: str) -> None:
    """New files beside the old ones (K3)."""
    df.write.mode("append").json(path)


def card(counts: dict[str, int], title: str) -> str:
    """A Markdown manifest of a published table (K6)."""
    total = sum(counts.values())
    lines = [f"# {title}", "", "| part | rows | share |", "|---|---|---|", *(f"| {k} | {n:,} | {n / max(1, total):.1%} |" for k, n in sorted(counts.items())), f"| total | {total:,} | 100.0% |"]
    return "\n".join(lines) + "\n"


def with_text(df: DataFrame) -> DataFrame:
    """Publish schema: no vectors, slogan and statement never null."""
    return df.drop("dense_vec", "embedding").withColumns({c: F.coalesce(c, F.lit("")) for c in ("slogan", "statement") if c in df.columns})
