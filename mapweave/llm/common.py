"""Helpers the operators share: written tables in the cluster's shared folder, size-checked broadcasts, word columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates the words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a lower-cased text, and those words in a text as written.
WORD_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RAW_WORD_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Rows up to which a table of keys (some dozens of bytes a row) is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Without one, a temporary folder on a single machine (tests), an error on a cluster."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mapweave-"))
        found = sc.getCheckpointDir()
    return found


_scopes: list[list[DataFrame]] = []


@contextlib.contextmanager
def temporary_tables() -> Iterator[None]:
    """Tables of ``written`` made inside are deleted at the end, so what is to stay must have been written with ``keep``.
    Without it they stay in the shared folder, since a result may still read them."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        discard(*made)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, reread: lost executors cost no recomputation, and plans start anew."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/mapweave-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    if _scopes and not keep:
        _scopes[-1].append(out)
    return out


def spare(docs: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of ``docs`` has."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that no later plan reads; one that is gone already is passed over."""
    for df in tables:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table) with a broadcast hint if a count shows at most ``limit`` rows; else as it is, for a shuffled join."""
    if df.count() > limit:
        return df
    out = F.broadcast(df)
    out._written_at = df._written_at
    return out


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept. Pure ASCII texts take the faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Lower-cased words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(ascii_lower(text), F.lit("")), WORD_GAP, -1), "")


def fingerprint(text: Column) -> Column:
    """64-bit hash that tells apart rows which share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
