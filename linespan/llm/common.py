"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where a local session names none (tests) is one made here and set; on a cluster the setting is required, as a
    temporary folder would lie on each machine's own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="linespan-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back.

    Cuts the lineage: what follows is read from shared files, so a lost executor costs no recomputation
    of what led here, and a plan with sampled range bounds can't change between its uses.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written(path_of: DataFrame | None = None) -> None:
    """Deletes what ``materialise`` wrote; ``path_of``: only what this DataFrame reads."""
    names = None if path_of is None else [f.rsplit("/", 1)[0] for f in path_of.inputFiles()]
    for item in list(_WRITTEN):
        spark, path = item
        if names is not None and not any(n.endswith(path.split("://")[-1]) for n in names):
            continue
        _WRITTEN.remove(item)
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may have ended; these are scratch files
        pass


def settle(make: Callable[[], DataFrame], what: str) -> DataFrame:
    """What ``make`` returns, materialised; then all that was written on the way to it is deleted."""
    before = len(_WRITTEN)
    out = materialise(make(), what)
    for spark, path in _WRITTEN[before:-1]:
        _WRITTEN.remove((spark, path))
        _delete(spark, path)
    return out


atexit.register(drop_written)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches to Python workers end at so many bytes, not only after 10 000 rows: rows may be long texts. A
    smaller limit of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("b")) > most:
        spark.conf.set(key, str(most))


def shielded(*internal: str) -> Callable:
    """For operators that add columns of these names on their way: columns of the input that are named alike, in any
    case, have another name meanwhile and come out as they were."""
    inside = {name.lower() for name in internal}

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            away = {}
            for c in docs.columns:
                if c.lower() in inside:
                    name = f"{c}_own"
                    while name.lower() in inside | {x.lower() for x in [*docs.columns, *away.values()]}:
                        name += "_"
                    away[c] = name
            return operator(docs.withColumnsRenamed(away), *args, **kwargs).withColumnsRenamed({v: k for k, v in away.items()})

        return run

    return wrap


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    """True for rows whose crc32(doc_id as text) leaves ``remainder``; a null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of == remainder
