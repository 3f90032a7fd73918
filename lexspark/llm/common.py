"""What the operators share: reading tables, shared intermediate tables, and neighbours in key order."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch on its way to Python: bounds a worker's memory when texts are long.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # shuffle files go when a write ends
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from spark.checkpoint.dir."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if spark.sparkContext.master.startswith("local["):  # one machine, as in tests: its warehouse will do
        return f"{spark.conf.get('spark.sql.warehouse.dir')}/lexspark"
    raise ValueError("set spark.checkpoint.dir to a folder that all machines share")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: the frame as a Parquet table in the shared folder, read again with its own schema."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


def removed(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    session = df.sparkSession
    path = session._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ARROW_ROWS at most at a time: a frame that was not read by table() comes in larger batches."""
    for batch in batches:
        for at in range(0, batch.num_rows, ARROW_ROWS):
            yield batch.slice(at, ARROW_ROWS)


def named(columns: list[str]) -> list[Column]:
    """Columns by their whole names, whatever characters these hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def free(df: DataFrame, name: str) -> str:
    """A name that no column of the frame has."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


LEAST = -(2**63)


def range_of(df: DataFrame, key: str, buckets: int, tie: Column | None = None) -> tuple[Column, int]:
    """A column of ranges of an integer key with about equally many rows, numbered in key order; gives their number.

    The bounds are approximate quantiles of the key alone (a column-pruned scan), so any bounds give right results. Null
    keys come first. A key that fills several quantiles gets buckets of its own, by ranges of the 64-bit hash `tie`: rows
    are in order by key, then tie, from bucket to bucket.
    """
    first = F.coalesce(F.col(key).cast("long"), F.lit(LEAST))
    wanted = [i / buckets for i in range(1, buckets)]
    got = [int(x) for x in df.select(first.alias("key")).approxQuantile("key", wanted, 0.2 / buckets)] if wanted else []
    hot = {x: n + 1 for x, n in Counter(got).items() if n > 1 and tie is not None}
    bounds = sorted({*got, *(x - 1 for x in hot if x > LEAST)})
    parts = [hot.get(x, 1) for x in bounds] + [1]
    begin = [sum(parts[:i]) for i in range(len(parts))]
    lists = [F.array(*[F.lit(x).cast("long") for x in xs]) for xs in (bounds, begin, parts)]
    place = F.size(F.filter(lists[0], lambda b: b < first)) if bounds else F.lit(0)
    bucket = F.get(lists[1], place)
    if hot:
        many = F.get(lists[2], place)
        bucket += F.least(F.floor((tie / F.lit(2.0**64) + 0.5) * many), many - 1)
    return bucket.cast("int"), sum(parts)


def ranged(df: DataFrame, key: str, buckets: int, tie: Column | None = None) -> tuple[DataFrame, int]:
    """Adds `bucket` by range_of()."""
    bucket, many = range_of(df, key, buckets, tie)
    return df.withColumn("bucket", bucket), many
