"""Where intermediate results go: a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, AtomicType, DataType, NullType, StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir`` or of the context's checkpoints. A local session
    without either (a test) gets a temporary one; on a cluster there is no folder to guess."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="wiretide-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once and read back: columns can be pruned, order and partitioning are lost."""
    path = f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, with its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@dataclass(frozen=True)
class Dealt:
    """Rows, the columns they are dealt by, over how many tasks, and their order there."""

    rows: DataFrame
    by: Sequence[str]
    order: Sequence[str]
    tasks: int


def checkpointed_as_dealt(dealt: Dealt) -> DataFrame:
    """The rows stored with the way they are dealt on record, so later steps on the same keys need no shuffle:
    as :class:`Buckets`, or, if a table cannot hold them, as a checkpoint. A window or a grouping by those keys
    finds rows in place; what asks for nothing may get them otherwise."""
    if _fits_a_table(dealt.rows.schema):
        buckets = Buckets(dealt.rows.sparkSession, "dealt", dealt.by, dealt.order, dealt.tasks)
        buckets.add(dealt.rows)
        return buckets.close()
    return _checkpointed_as_dealt(dealt.rows.sortWithinPartitions(*dealt.by, *dealt.order))


def _checkpointed_as_dealt(df: DataFrame) -> DataFrame:
    """Only a plan that is fixed before it runs can promise how rows are dealt, so this one is; it should deal
    its rows itself and hold no join that relies on run-time sizes."""
    with _set(df.sparkSession, "spark.sql.adaptive.enabled", "false"):
        return checkpointed(df)


def _fits_a_table(schema: StructType) -> bool:
    names = [f.name.lower() for f in schema]
    return len(set(names)) == len(names) and all(_plain(f.dataType) for f in schema)


def _plain(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return len(kind) > 0 and _fits_a_table(kind)
    if isinstance(kind, ArrayType):
        return _plain(kind.elementType)
    return isinstance(kind, AtomicType) and not isinstance(kind, NullType) and "interval" not in kind.simpleString()


@contextmanager
def _set(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    try:
        spark.conf.set(name, value)
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


class Buckets:
    """Rows kept as a table in the shared folder, in buckets by the hash of ``by``: compressed columns, of which
    a reader takes those it needs. Only its description is in the catalog, until it is closed. Rows that come
    dealt by the same hash write a file a task. The shuffles behind what was written are given up."""

    def __init__(self, spark: SparkSession, what: str, by: Sequence[str], order: Sequence[str], count: int):
        self.spark, self.by, self.order, self.count = spark, list(by), list(order), count
        self.name = f"wiretide_{what}_{uuid.uuid4().hex}"
        self.path = f"{shared_folder(spark)}/{self.name}"

    def add(self, rows: DataFrame) -> None:
        made = rows.write.format("parquet").mode("append").option("path", self.path).option("compression", "zstd")
        ordered = made.bucketBy(self.count, *self.by).sortBy(*dict.fromkeys([*self.by, *self.order]))
        with _set(self.spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            ordered.saveAsTable(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def close(self) -> DataFrame:
        """All rows. The table's description is dropped, its files stay."""
        found = self.rows()
        self.spark.sql(f"DROP TABLE {self.name}")
        return found
