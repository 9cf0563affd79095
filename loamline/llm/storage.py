"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
#: Tables written inside each open ``scratch``.
_scopes: list[list[DataFrame]] = []


def shared_root(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; a temporary one only for a local session that names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="loamline-shared-")
    return _own[app]


def materialise(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back; ``few``: by no more tasks than there are cores, and so in no more files.

    Cuts the lineage, so lost executors only cost re-reading, and forgets the
    physical partitioning, so that a later join exchanges both sides and
    adaptive execution can split a skewed key.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/loamline/{name}-{uuid.uuid4().hex}"
    (df.coalesce(max(1, spark.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loamline_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Delete the tables written inside, but for those ``kept``, once what they lead to is written."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            discard(df)


def kept(df: DataFrame) -> DataFrame:
    """Leave a table to the scope around the current ``scratch``."""
    _scopes[-1][:] = [x for x in _scopes[-1] if x is not df]
    if len(_scopes) > 1:
        _scopes[-2].append(df)
    return df


#: Rows up to which a written table is sent whole to the executors instead of exchanging what it joins.
MOST_SENT = 1_000_000


def sent_if_small(df: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """``df`` marked for a broadcast join if it, or ``rows`` that it was made of, is small; beyond that both sides are exchanged.

    The result is the same either way. Counting a written table reads its files' footers, once.
    """
    counted = df if rows is None else rows
    if not hasattr(counted, "_loamline_rows"):
        counted._loamline_rows = counted.count()
    return F.broadcast(df) if counted._loamline_rows <= MOST_SENT else df


def discard(df: DataFrame | None) -> None:
    """Delete a table that ``materialise`` wrote, once nothing reads it any more."""
    path = getattr(df, "_loamline_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
