"""What the training-data operators share: tables in the cluster's shared
folder, connected components, and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but the space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_own_dirs: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []
#: A table's path to a weak reference to what its readers' plans hold.
_readers: dict[str, tuple[SparkSession, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where that is unset: one
    of our own in local mode, and the warehouse, which a cluster shares."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_halyard"
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="halyard-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return f"file://{_own_dirs[app]}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def remove_written() -> None:
    """At the driver's end nothing reads the tables any more."""
    for spark, path in _written:
        if spark.sparkContext._jsc is None:
            return
        with contextlib.suppress(Exception):  # the JVM may have gone first
            remove(spark, path)


#: Spark's setting that deletes a query's shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def remove_unread(spark: SparkSession) -> None:
    """Delete the tables that no plan of the driver refers to any more."""
    for path, (owner, reader) in list(_readers.items()):
        if owner.sparkContext is spark.sparkContext and reader.refersTo(None):
            del _readers[path]
            remove(spark, path)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written once as Parquet in the shared folder and read back, and its path.

    The shuffle files of the write go as it ends, not when the driver happens
    to collect its garbage."""
    spark = df.sparkSession
    remove_unread(spark)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _written.append((spark, path))
    back = spark.read.schema(df.schema).parquet(path)
    # All plans over the table share this object.
    location = back._jdf.queryExecution().analyzed().relation().location()
    _readers[path] = spark, spark._jvm.java.lang.ref.WeakReference(location)
    return back, path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    Cuts the lineage where a table feeds several branches. Unlike
    localCheckpoint, the rows survive a lost executor. Tables are deleted when
    the driver has no plan left that reads them, or as it ends."""
    return written(df, name)[0]


@contextlib.contextmanager
def result_only(spark: SparkSession) -> Iterator[set[str]]:
    """Delete the tables written within, but for the paths added to the set."""
    first, keep = len(_written), set()
    yield keep
    for _, path in _written[first:]:
        if path not in keep:
            remove(spark, path)


#: Spark's limit of the bytes that a task sends to Python at once (64 MB
#: unless set), and the one that small_batches sets.
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within sends BATCH_BYTES to Python at once: a batch is held by
    the JVM's buffers, by the worker's and as the rows it is read into."""
    before = spark.conf.get(BATCH_LIMIT)
    spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_LIMIT, before)


_held: dict[tuple, object] = {}


def held(make: Callable, *args):  # noqa: ANN201
    """make(*args), kept for a worker's next tasks until another such thing is
    asked for: workers serve all stages, and what each needs would add up."""
    if (make, args) not in _held:
        forget()
        _held[make, args] = make(*args)
    return _held[make, args]


def forget() -> None:
    _held.clear()


def give_back() -> None:
    """Return to the system what this worker's allocators keep for later."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(scan: Callable, keep: bool = False) -> Callable:
    """scan, in a worker that first lets go of what is held (unless keep), and
    gives memory back before and after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep:
            forget()
        give_back()
        yield from scan(batches)
        give_back()

    return run


#: Keys that are spread by spread_join: at most this many, so they are small
#: enough to be broadcast; and the tasks that each is spread over.
HOT_KEYS, SALTS = 512, 64


def spread_join(rows: DataFrame, found: DataFrame, keys: list[str], total: int, least: int = 1000) -> DataFrame:
    """rows joined with found (one row a key; n: how many of rows have it,
    which is left out of the result).

    A key of more than total / HOT_KEYS rows is hot: found's row of it goes to
    SALTS tasks and the rows are dealt among these. There are HOT_KEYS hot keys
    at most, whatever the input, and only their keys are broadcast."""
    limit = max(least, total // HOT_KEYS + 1)
    found = found.withColumnRenamed("n", "times_")
    hot = found.where(F.col("times_") >= limit).select(*keys, F.lit(True).alias("hot_"))
    salt = F.when(F.col("hot_"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("salt_", salt).drop("hot_")
    salts = F.when(F.col("times_") >= limit, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    # Both sides grow with the input, so neither is broadcast.
    spread = found.withColumn("salt_", F.explode(salts)).drop("times_")
    return dealt.join(spread.hint("merge"), [*keys, "salt_"]).drop("salt_")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1) from a hash of the columns."""
    h = F.xxhash64(*parts)
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lowest_linked(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index linked to each of n, directly or not."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


#: Edges of one node from which it is salted; edges of a task.
HEAVY, TASK_EDGES = 1000, 1_000_000


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as one star per component, around its least id;
    moved: the edge is a new one."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if not parts:
        return
    u, v = (np.concatenate(x) for x in zip(*parts))
    ids, at = np.unique(np.r_[u, v], return_inverse=True)
    i, j = at[: len(u)], at[len(u) :]
    root = lowest_linked(len(ids), i, j)
    own = np.flatnonzero(root != np.arange(len(ids)))
    old = np.isin(own * len(ids) + root[own], i * len(ids) + j)
    yield pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]]), pa.array(~old)], names=["u", "v", "moved"])


def connected_components(edges: DataFrame, max_rounds: int = 60, heavy: int = HEAVY) -> DataFrame:
    """Smallest id reachable from each id of an undirected edge list.

    edges: columns u, v (long). Returns (id, component_id) for every id that
    has an edge to another id; an empty list gives an empty table. In a round,
    an edge goes to the tasks of both its ends, and each task replaces its
    edges by stars; the edges are written to the shared folder between rounds,
    and those of the round before deleted. A path halves with each round. The
    edges towards a node that has over `heavy` of them, or over 1 / HOT_KEYS of
    all, are salted, and that node's own edges go to all salts; so no component
    is ever gathered in one task, and at most HOT_KEYS such nodes are
    broadcast. Tasks take about TASK_EDGES edges."""
    spark = edges.sparkSession
    links = edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v")
    links, path = written(links, "cc")
    total = links.count()
    for _ in range(max_rounds):
        limit = max(heavy, total // HOT_KEYS + 1)
        no = F.lit(0).cast("long")
        hubs, hubs_path = written(links.groupBy("v").agg(F.count("*").alias("n")).where(F.col("n") > limit).select(F.col("v").alias("node")), "hubs")
        up = links.select("u", "v", F.col("u").alias("node"), no.alias("salt"))
        down = links.select("u", "v", F.col("v").alias("node")).join(F.broadcast(hubs.withColumn("hub", F.lit(True))), "node", "left")
        down = down.select("u", "v", "node", F.when(F.col("hub"), F.pmod(F.xxhash64("u"), F.lit(SALTS).cast("long"))).otherwise(no).alias("salt"))
        every = F.explode(F.sequence(F.lit(1).cast("long"), F.lit(SALTS - 1).cast("long")))
        own = links.withColumn("node", F.col("u")).join(F.broadcast(hubs), "node").select("u", "v", "node", every.alias("salt"))
        both = up.unionByName(down).unionByName(own)
        # Without a number, few edges are read by few tasks.
        parts = -(-2 * total // TASK_EDGES)
        deal = [parts] if parts > shuffle_partitions(spark) else []
        before = [path, hubs_path]
        links, path = written(both.repartition(*deal, "node", "salt").select("u", "v").mapInArrow(lean(contract), "u long, v long, moved boolean"), "cc")
        for old in before:
            remove(spark, old)
        total, moved = links.agg(F.count("*"), F.count_if("moved")).first()
        if not moved:
            break
        links = links.drop("moved")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = links.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component_id"))
    return members.unionByName(links.select(F.col("v").alias("id"), F.col("v").alias("component_id")).distinct())
