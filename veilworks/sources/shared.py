"""Tables in the folder that driver and executors share, to cut lineage where a result is used more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from veilworks.functions import crypto

#: Folders of sessions that have none set, by application; only where all runs on one machine.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of its own only where that is unset and all run on one machine, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = f"file://{tempfile.mkdtemp(prefix='veilworks-')}"
        where = _own[app]
    return where.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder once and read it back; its path is kept in `written_to`."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables of `written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_sealed(df: DataFrame, tag: str, key: bytes, clear: tuple[str, ...] = ()) -> DataFrame:
    """`written`, with strings and what may hold them sealed in the file and opened as they are read; not those named in clear."""
    names = [f"c{i}" for i in range(len(df.columns))]
    shut = [f.name not in clear and isinstance(f.dataType, (StringType, ArrayType, MapType, StructType)) for f in df.schema.fields]
    flat = crypto.with_key(df.toDF(*names), key)
    of = F.lit(tag)
    as_text = lambda c, f: F.col(c) if isinstance(f.dataType, StringType) else F.to_json(c)
    stored = written(flat.select(*[crypto.sealed(as_text(c, f), of).alias(c) if s else F.col(c) for c, f, s in zip(names, df.schema.fields, shut, strict=True)]), tag)
    back = lambda c, f: crypto.opened(F.col(c), of) if isinstance(f.dataType, StringType) else F.from_json(crypto.opened(F.col(c), of), f.dataType)
    out = crypto.with_key(stored, key).select(*[back(c, f).alias(f.name) if s else F.col(c).alias(f.name) for c, f, s in zip(names, df.schema.fields, shut, strict=True)])
    out.written_to = stored.written_to
    return out


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out anew if its scan has fewer tasks than there are cores, for work that costs more than a shuffle of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Rows of a batch that goes to a Python worker: texts of any length are held there more than once.
BATCH_ROWS = 256


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Batches of few rows, so that what a Python worker holds does not grow with its partition; never of more than are set."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = int(spark.conf.get(name))
    spark.conf.set(name, str(min(held, rows) if held > 0 else rows))


class Scratch:
    """Tables that live as long as a with block: what is read after it has to be written by `keep`, or to the caller's own place."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables.append(written(df, tag))
        return self.tables[-1]

    @staticmethod
    def keep(df: DataFrame, tag: str) -> DataFrame:
        """A table that outlives the block; its reader deletes it by `drop`."""
        return written(df, tag)

    def __exit__(self, *_: object) -> None:
        drop(*self.tables)
        self.tables.clear()
