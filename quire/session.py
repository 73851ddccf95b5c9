"""Session helpers shared by every operator: session, durable cuts, spreading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def local_session(app: str = "quire", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def _folder(spark: SparkSession) -> str:
    """The shared folder for cuts; a temporary one only where the session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="quire-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Write a wide intermediate once as a compressed table in the shared folder and read it back.

    For texts that several branches scan: columnar, so a branch reads only the
    columns it needs, and independent of the executors that wrote it.
    """
    path = f"{_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the table that :func:`stored` wrote for ``df``; only once nothing will read it again."""
    path = df.__dict__.pop("stored_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def durable(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage with a reliable checkpoint.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only
    where that is unset and no folder was set by hand (tests) a temporary one is
    made. The files outlive lost executors.
    """
    _folder(df.sparkSession)
    return df.checkpoint(eager=eager)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan that has fewer partitions than the cluster has cores.

    A file with a single row group is one task however many cores there are;
    before CPU-heavy text work that is worth one shuffle. Scans that already
    split widely are returned unchanged, so large inputs never pay for it.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, *keys) if keys else df.repartition(want)


#: Bytes of a side that is broadcast at most.
BROADCAST_BYTES = 32 << 20
#: Rows of one key that meet in one task at most; more rows are dealt to pairs of blocks.
BLOCK_ROWS = 2_000


def _width(df: DataFrame) -> int:
    """Bytes of a row as held in memory: fixed types by size, others by a usual length."""
    from pyspark.sql.types import BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, TimestampType

    fixed = (BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, TimestampType)
    return 24 + sum(8 if isinstance(f.dataType, fixed) else 64 for f in df.schema.fields)


def sized_broadcast(df: DataFrame, max_rows: int | None = None, rows: int | None = None) -> DataFrame:
    """Mark a side for broadcast only when its counted rows, by their width, stay under ``BROADCAST_BYTES``.

    ``df`` should be durable or cached, since it is counted here unless ``rows``
    is given. Beyond the bound (or ``max_rows``) the side is returned unmarked and
    the join shuffles; the rows that come out are the same.
    """
    most = BROADCAST_BYTES // _width(df)
    most = most if max_rows is None else min(most, max_rows)
    n = df.limit(most + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= most else df


def pairs_within(members: DataFrame, key: str, item: str, block: int = BLOCK_ROWS) -> DataFrame:
    """(key, x, y): every two different items of one key, x < y, each pair once.

    ``members`` holds distinct (key, item). The items of a key with more than
    ``block`` of them are dealt to blocks and meet per pair of blocks, so no task
    gets more than two blocks of one key. Null keys and items give no pair.
    """
    rows = members.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(F.col(key).alias("k"), F.col(item).alias("v"))
    sizes = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1")
    dealt = rows.join(sizes, "k").withColumn("parts", F.ceil(F.col("n") / block).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("k", "v", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    a, b = dealt.alias("a"), dealt.alias("b")
    same = (F.col("a.k") == F.col("b.k")) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi")) & (F.col("a.v") < F.col("b.v"))
    # Two items of one block meet under every pair of blocks with theirs; only the pair of both their own counts.
    once = (F.least("a.own", "b.own") == F.col("a.lo")) & (F.greatest("a.own", "b.own") == F.col("a.hi"))
    return a.join(b, same & once).select(F.col("a.k").alias(key), F.col("a.v").alias("x"), F.col("b.v").alias("y"))


def hash_sample(df: DataFrame, by: str, key: str, groups: list, n: int, seed: int) -> DataFrame:
    """(key, by): of each listed group at most ``n`` keys, the first by a hash.

    One pass counts the groups, a second keeps the keys below a hash threshold that
    passes a little more than ``n`` of each, and only those few are ranked, so a
    group with a third of all rows is never sorted.
    """
    own = df.where(F.col(by).isin(groups) & F.col(key).isNotNull()).select(key, by)
    counts = {r[by]: r["n"] for r in own.groupBy(by).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return own.limit(0)
    share = {g: min(1.0, (n + 10 * n**0.5 + 30) / c) for g, c in counts.items()}
    draw = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    few = own.withColumn("draw", draw).where(F.col("draw") < F.create_map(*[F.lit(x) for kv in share.items() for x in kv])[F.col(by)])
    place = F.row_number().over(Window.partitionBy(by).orderBy("draw", key))
    return few.distinct().withColumn("place", place).where(F.col("place") <= n).select(key, by)
