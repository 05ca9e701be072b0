"""What the operators of this subpackage share: scratch tables, Arrow maps and table loading."""

from __future__ import annotations

import atexit
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches hold at most this many rows and bytes, so that very long texts don't fill a worker.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests on one machine), a temporary folder is taken."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="arkline-")
    return _own[app]


_folders: dict[str, object] = {}


def _forget() -> None:
    for folder, spark in _folders.items():
        try:
            remove(spark, folder)
        except Exception:  # noqa: BLE001  the session may have ended already
            pass


def remove(spark: SparkSession, folder: str) -> None:
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again.

    This cuts the lineage: what is read later doesn't depend on shuffle files of a lost executor."""
    spark = df.sparkSession
    if not _folders:
        atexit.register(_forget)
    folder = f"{shared_dir(spark)}/arkline-{uuid.uuid4().hex}-{name}"
    _folders[folder] = spark
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out._arkline_folder = folder
    return out


def drop_staged(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    folder = getattr(df, "_arkline_folder", None)
    if folder:
        remove(df.sparkSession, folder)
        _folders.pop(folder, None)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` with bounded batches; ``make`` builds the batch function once in each task."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield each(batch)

    return df.mapInArrow(run, schema)


#: The columns of documents that operators read; an operator that keeps columns renames all others while it works.
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def keeping_columns(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets ``f(docs, ...)``, which returns the columns it gets, work beside extra columns of any names."""

    @functools.wraps(f)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        names = docs.columns
        inner = docs.toDF(*[n if n in DOCUMENT else f"_extra{i}" for i, n in enumerate(names)])
        return f(inner, *args, **options).toDF(*names)

    return run


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join to an aggregate by its own keys, whose two sides are dealt out for the join alone.

    A join that takes an aggregation's partitioning over can't be split where a key is hot.  A second key that follows from
    the first ones makes Spark deal both sides anew, so it can."""
    more = F.xxhash64(*keys, F.lit(1))
    return left.withColumn("_again", more).join(right.withColumn("_again", more), [*keys, "_again"], how).drop("_again")


#: Bits of a filter of row keys: a fixed size (4 MiB) whatever the input.  When it fills up it holds less back; what it lets pass is joined exactly.
FILTER_BITS = 1 << 25
_GROUP_BITS = 1 << 15


def _bit(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def key_filter(rows: DataFrame, keys: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Adds to a table with the columns ``keys`` whether a row of ``rows`` may have its keys (column _met); false is certain.

    The bits are set where the rows lie and put together in groups; the driver gets FILTER_BITS bits at most."""
    marked = rows.select(_bit(keys).alias("at")).groupBy((F.col("at") / _GROUP_BITS).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("at") % _GROUP_BITS).alias("bits"))
    bits = np.zeros((FILTER_BITS // _GROUP_BITS, _GROUP_BITS // 8), np.uint8)
    for k, found in marked.collect():
        bits[k] = np.frombuffer(found, np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits.reshape(-1))

    @F.pandas_udf("boolean")
    def met(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        return pd.Series((sent.value[at >> 3] >> (at & 7) & 1).astype(bool))

    return lambda df: df.withColumn("_met", met(_bit(keys)))


def wide(spark: SparkSession, least: int = 1) -> int:
    """Partitions to deal rows over: the session's number of shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
