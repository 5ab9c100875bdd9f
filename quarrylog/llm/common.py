"""Shared plumbing: durable intermediate tables, inputs and connected components."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_KEPT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share; in local mode a temporary one where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"{tempfile.gettempdir()}/quarrylog-checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Rows and bytes of a batch that goes to Python; Spark's own default of 10,000 whole texts takes too much memory.
BATCH_SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    """Keep batches for Python functions small, unless the session asks for smaller ones."""
    for key, most in BATCH_SETTINGS.items():
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= int(most):
            spark.conf.set(key, most)


def materialize(df: DataFrame, label: str = "t") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage so that a lost executor costs a re-read instead of a
    recomputation, fixes values such as monotonically increasing ids, and lets
    the shuffle files of the steps before be removed.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    path = f"{shared_dir(spark)}/quarrylog/{label}-{uuid.uuid4().hex}"
    _drop_shuffles(spark)  # of the step before, whose events may have held them when it ended
    df.write.parquet(path)
    _KEPT.append((spark, path))
    _drop_shuffles(spark)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote and nothing reads any more."""
    paths = {t._stored_at for t in tables}
    gone = [k for k in _KEPT if k[1] in paths]
    _KEPT[:] = [k for k in _KEPT if k[1] not in paths]
    release(gone)


def _drop_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the files of shuffles that nobody refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What a function for ``beside`` yields: the input rows its output rows stem from, and the columns it makes.
Made = tuple[Sequence[int], dict[str, Sequence]]


def beside(df: DataFrame, factory: Callable[[], Callable[[pd.DataFrame], Iterable[Made]]], reads: Sequence[str], makes: str, keeps: Sequence[str] = ()) -> DataFrame:
    """Run Python over the columns ``reads``; the columns ``keeps`` travel beside it and never leave Arrow.

    pandas has no integers with gaps, so an id that goes through it beside a null
    loses its low digits. Here ids and columns of any other type stay as they are.
    ``factory`` is called once a task; what it returns gets frames of ``reads``
    and yields pairs (rows, columns): the positions in the frame that the output
    rows stem from, and the made columns. The result has ``keeps`` and then ``makes``.
    """
    made = StructType.fromDDL(makes)
    schema = StructType([*(df.schema[k] for k in keeps), *made.fields])
    # Positions tell the columns apart, whatever their names.
    inner = df.select(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keeps)], *[F.col(f"`{r}`").alias(f"r{i}") for i, r in enumerate(reads)])
    typed = StructType.fromDDL(", ".join(f"c{i} int" for i in range(len(schema.fields))))
    for field, like in zip(typed.fields, schema.fields, strict=True):
        field.dataType = like.dataType
    names, columns, n_kept = list(made.names), list(reads), len(keeps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, target = factory(), to_arrow_schema(typed)
        for batch in batches:
            frame = pa.Table.from_batches([batch.select(range(n_kept, n_kept + len(columns)))]).rename_columns(columns).to_pandas()
            for rows, new in work(frame):
                index = pa.array(np.asarray(rows, dtype=np.int64))
                arrays = [batch.column(i).take(index).cast(target.field(i).type) for i in range(n_kept)]
                arrays += [pa.array(new[c], type=target.field(n_kept + i).type, from_pandas=True) for i, c in enumerate(names)]
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

    return inner.mapInArrow(run, typed).toDF(*schema.names)


def free_name(name: str, *taken: DataFrame) -> str:
    """``name``, or with underscores in front if a table has such a column."""
    used = {c.lower() for t in taken for c in t.columns}
    while name.lower() in used:
        name = f"_{name}"
    return name


def others(df: DataFrame, *without: str) -> list[str]:
    """The columns of ``df`` but some, in order."""
    low = {w.lower() for w in without}
    return [c for c in df.columns if c.lower() not in low]


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The same rows in smaller frames, for functions whose output is larger than their input."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows]


def release(kept: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete the tables that ``materialize`` wrote."""
    todo = _KEPT if kept is None else kept
    while todo:
        spark, path = todo.pop()
        if spark.sparkContext._jsc is None:
            continue
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _release_quietly() -> None:
    try:
        release()
    except Exception:  # the JVM may already be gone  # noqa: BLE001
        pass


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``(node, component)`` per node.

    ``component`` is the smallest node reachable. Every round hooks each node to
    its smallest neighbour, jumps pointers until all point at a root, and keeps
    only the edges between different roots, so the edge table shrinks by at
    least half its nodes per round. Null ends and loops are ignored.
    """
    live = materialize(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    labels = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).union(live.select("b", "a"))
        parent = materialize(
            both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("parent")),
            "hook",
        )
        while True:
            before, up = parent, parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            parent = materialize(
                parent.select("node", "parent").join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")),
                "jump",
            )
            discard(before)
            if parent.where("moved").isEmpty():
                break
        parent = parent.drop("moved")
        if labels is None:
            labels = parent.select("node", F.col("parent").alias("component"))
        else:
            step = parent.select(F.col("node").alias("component"), "parent")
            labels = materialize(
                labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")),
                "labels",
            )
        at_a = parent.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        at_b = parent.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        live = materialize(
            live.join(at_a, "a").join(at_b, "b").where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
            "edges",
        )
    return labels if labels is not None else live.select(F.col("a").alias("node"), F.col("b").alias("component"))
