"""Shared helpers of the training-data operators: stable row keys, checkpoints, table reading, word splitting."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Maps the bytes A-Z to a-z and each ASCII byte that is neither letter nor digit to a blank; other bytes stay.
ALNUM_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)
#: Maps only A-Z to a-z.
LOWER_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Blanks of the white-space word rule; bytes.split() also splits at 0x0B and 0x0C, which the rule has too.
ASCII_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(c: Column) -> Column:
    """Lower-cases A-Z only, whatever the locale."""
    return F.translate(c, UPPER, LOWER)


def row_key(*cols: str | Column) -> Column:
    """128-bit key of a row's content: equal rows share it, so results keyed by it are the same for repeated rows.

    Unlike a generated row number it does not change when a lost task is run again.
    """
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat(
        F.hex(F.xxhash64(*parts, F.lit(1))), F.lit("-"), F.hex(F.xxhash64(F.lit(2), *parts, *[p.isNull() for p in parts]))
    )


def once(c: Column, then: Callable[[Column], Column]) -> Column:
    """then(c) with c worked out once for each row: the optimizer would copy a column's expression into a lambda's body."""
    return F.transform(F.array(c), then)[0]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for passing use that no column of df has, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names.

    Where none is named, a session on one machine, as in tests, gets a folder of its own; a cluster is refused, as its machines
    don't see each other's folders.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Checkpoints df in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def with_few(rows: DataFrame, few: DataFrame, keys: list[str], most: int = 500_000) -> DataFrame:
    """rows joined to a table of one row for each key, made already (see cut), which is broadcast if its number, which is checked, allows it.

    A key of many rows then stays spread; beyond the bound both sides are shuffled, and Spark splits skewed keys.
    """
    return rows.join(F.broadcast(few) if few.count() <= most else few, keys)


@contextmanager
def bucketed(df: DataFrame, key: str) -> Iterator[DataFrame]:
    """df as a table in the warehouse, bucketed by key, so that joins on key don't shuffle it; table and files are dropped afterwards."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows, without copies, so that what a worker builds from one part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def alnum_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased, as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "replace").translate(ALNUM_BYTES).split() if text else []


def blank_words(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z lower-cased, as UTF-8 bytes; null has none."""
    return text.encode("utf-8", "replace").translate(LOWER_BYTES).split() if text else []
