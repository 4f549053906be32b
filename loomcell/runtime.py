"""Session helpers: shared storage, size-checked lookups, skew-safe joins."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A lookup side is broadcast only when it has at most so many rows and bytes. The driver
#: holds it several times over while it is made (rows, hash table, pieces to be sent).
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: The same where the alternative is a shuffle without copies.
UNCOPIED_BYTES = 8 << 20
#: What a row of a hash table takes besides its texts: headers and pointers, and a column.
ROW_BYTES, COLUMN_BYTES = 64, 16
#: Copies of the smaller side in a salted join: at least, at most. In between a quarter
#: of the session's shuffle partitions, so a hot key fills that share of the tasks;
#: Spark splits what is still skewed when it runs.
SALTS, MOST_SALTS = 16, 128

_SHIPPED: set[str] = set()


def load(spark: SparkSession, directory: str, table: str) -> DataFrame:
    """One table of a directory of Parquet tables."""
    return spark.read.parquet(f"{directory}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors: the one the cluster names in
    ``spark.checkpoint.dir``; only where that is unset (tests) an own one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomcell-"))
    return sc._jsc.sc().getCheckpointDir().get()


_SPOOLED: list[str] = []


def spool(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again.

    Cuts the lineage and survives lost executors like a checkpoint. It also ends
    the size estimates: a checkpoint keeps those of its plan, and over the rounds
    of an iteration their products grow to numbers that the planner can't handle
    in reasonable time; a written table has its true size. The files go when the
    session's process ends, or by clear()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spool-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _SPOOLED:
        atexit.register(clear, spark)
    _SPOOLED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove all intermediate tables; DataFrames built on them can't run then."""
    while _SPOOLED:
        remove(spark, _SPOOLED.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path on any Hadoop file system; errors are of no consequence."""
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session may be gone already
        pass


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a cluster, once a session."""
    sc = spark.sparkContext
    if sc.master.startswith("local[") or sc.master == "local" or sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="loomcell-")) / "loomcell_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in root.rglob("*.py"):
            z.write(p, Path(root.name) / p.relative_to(root))
    sc.addPyFile(str(target))  # served from here as long as the session lives
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int | None = None) -> bool:
    """Whether df has at most so many rows, and takes no more bytes as a hash table than
    may be broadcast (BROADCAST_BYTES or most); reads no more than it must."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    nested = [F.coalesce(F.octet_length(F.to_json(F.struct(f.name))), F.lit(0)) for f in df.schema if f.dataType.simpleString().startswith(("array", "struct", "map"))]
    size = reduce(Column.__add__, [*texts, *nested], F.lit(ROW_BYTES + COLUMN_BYTES * len(df.columns)))
    n, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).first()
    return n <= rows and held <= (BROADCAST_BYTES if most is None else most)


def salts(spark: SparkSession) -> int:
    return max(SALTS, min(MOST_SALTS, int(spark.conf.get("spark.sql.shuffle.partitions")) // 4))


def lookup_join(big: DataFrame, small: DataFrame, key: str | list[str], how: str = "inner", spread: Column | None = None,
                rows: int = BROADCAST_ROWS, n_small: int | None = None, salted: bool = True) -> DataFrame:
    """Join on a key (one column or several) of which ``big`` may hold a third of its rows.

    ``small`` is broadcast if its counted rows and bytes are under the bounds;
    otherwise both sides are shuffled on (key, salt): ``big`` by the hash of
    ``spread``, ``small`` copied salts() times, so no task gets a whole hot key.
    how: inner, left, left_semi or left_anti. A null key matches nothing. n_small:
    the small side's count, where it is known already and its rows are short. salted:
    False where ``small`` grows with the data, so that its copies would outweigh
    ``big``: each row is then shuffled once, and Spark splits what a hot key makes too
    large for a task when it runs.
    """
    if n_small <= rows if n_small is not None else is_small(small, rows, BROADCAST_BYTES if salted else UNCOPIED_BYTES):
        return big.join(F.broadcast(small), key, how)
    if not salted:
        return big.join(small.hint("merge"), key, how)  # sorts go to disk, a hash table can't
    salt, n = "__salt", salts(big.sparkSession)
    left = big.withColumn(salt, F.pmod(F.xxhash64(spread if spread is not None else F.monotonically_increasing_id()), F.lit(n)).cast("int"))
    right = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*([key] if isinstance(key, str) else key), salt], how).drop(salt)


def latest(df: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The row of each key with the greatest order columns (nulls lowest).

    Partially aggregated before the shuffle, so copies and versions of a hot key
    don't travel. Rows equal in all order columns: the greatest values win, so
    the result doesn't depend on file order."""
    picked = F.max(F.struct(*order, *values)).alias("__top")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"__top.{c}").alias(c) for c in [*order, *values]])


#: A key with more rows isn't given to one task of a window.
HOT_ROWS = 1_000_000


def has_hot_key(df: DataFrame, key: str, rows: int = HOT_ROWS) -> bool:
    """Whether some key has more rows than that; counts are pre-aggregated."""
    return not df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > rows).limit(1).isEmpty()


def spread_previous(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Add `prev` (the value of the key's row before, in a total order) and `nth`
    (0-based number within the key), whatever the size of a key.

    Rows are cut into ranges along (key, order), so a key with a third of all rows
    spans many tasks; only one row per key and range meets in one task, to hand the
    last value and the count over to the next range."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = spool(df.repartitionByRange(parts, key, *order).withColumn("__p", F.spark_partition_id()))
    w = Window.partitionBy(key, "__p").orderBy(*order)
    own = r.withColumn("__prev", F.lag(value).over(w)).withColumn("__i", F.row_number().over(w) - 1)
    ends = r.groupBy(key, "__p").agg(F.count("*").alias("__n"), F.max(F.struct(*order, F.col(value).alias("__v"))).alias("__l"))
    v = Window.partitionBy(key).orderBy("__p")
    ends = ends.select(key, "__p", F.lag("__l.__v").over(v).alias("__carry"), F.coalesce(F.sum("__n").over(v.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    j = own.join(ends, [key, "__p"])
    return j.withColumn("prev", F.when(F.col("__i") == 0, F.col("__carry")).otherwise(F.col("__prev"))).withColumn("nth", (F.col("__i") + F.col("__before")).cast("int")).drop("__p", "__prev", "__i", "__carry", "__before")


def spread_next(df: DataFrame, key: str, order: list[str], value: str, name: str) -> DataFrame:
    """Add under `name` the value of the key's next row in a total order (null after
    the last), whatever the size of a key; by ranges like spread_previous."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    r = spool(df.repartitionByRange(parts, key, *order).withColumn("__p", F.spark_partition_id()))
    w, v = Window.partitionBy(key, "__p").orderBy(*order), Window.partitionBy(key).orderBy("__p")
    heads = r.groupBy(key, "__p").agg(F.min(F.struct(*order, F.col(value).alias("__v"))).alias("__h"))
    heads = heads.select(key, "__p", F.lead("__h.__v").over(v).alias("__carry"))
    own = r.withColumn("__own", F.lead(value).over(w)).withColumn("__last", F.lead(F.lit(1)).over(w).isNull())
    return own.join(heads, [key, "__p"]).withColumn(name, F.when(F.col("__last"), F.col("__carry")).otherwise(F.col("__own"))).drop("__p", "__own", "__last", "__carry")
