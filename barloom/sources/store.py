"""Stored bars, snapshots and the three account tables.

The bar table is parquet under ``symbol=/month=`` folders per write epoch.
Writers only add epochs, so a retried write replaces its own folder and a lost
executor costs nothing; readers take the newest row per key. Compaction writes
the newest rows into a base beside the epochs and then names it in a manifest;
readers of a compacted table take the base as it is and merge only epochs that
came after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import atoms
from barloom.operators.bars import keep_latest, newest_rows
from barloom.session import broadcast_if_small

BAR = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType()),
    *[T.StructField(x, T.DoubleType()) for x in ("o", "h", "l", "c", "v")],
])
DECISIONS = (
    "id long, ts timestamp, symbol string, timeframe string, condition string, proposed_prob double, calibrated_prob double,"
    " direction string, action string, reason string, equity double, size double, entry double, raw_signal string"
)
TRADES = (
    "id long, symbol string, timeframe string, condition string, stated_prob double, entry_ts timestamp, entry_price double,"
    " exit_ts timestamp, exit_price double, size double, exit_reason string, entry_fee double, exit_fee double, pnl double,"
    " pnl_pct double, hit boolean, lot_id long"
)
SNAPSHOTS = "ts timestamp, equity double, baseline double, note string"


def write_epoch(bars: DataFrame, path: str, epoch: int) -> None:
    """Add or replace one epoch of bars."""
    (
        bars.withColumn("month", F.date_format("ts", "yyyy-MM"))
        .repartition("symbol", "month")
        .write.mode("overwrite").partitionBy("symbol", "month").parquet(f"{path}/epoch={epoch}")
    )


STORED = T.StructType([*BAR.fields, T.StructField("month", T.StringType())])


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none where there is no folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def live_base(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(base, last epoch in it) of the newest manifest; a base that no manifest names does not exist for readers."""
    if not _folders(spark, f"{path}.manifest"):
        return None
    row = spark.read.schema("version long, epoch long").json(f"{path}.manifest/*").orderBy(F.desc("version")).first()
    return (row["version"], row["epoch"]) if row else None


def compact(spark: SparkSession, path: str) -> int:
    """Write the newest rows as a base of its own, then the manifest that makes it live; returns the base's number.

    Nothing is deleted and no live file is touched, so readers of the former state go on. After a crash between the two
    writes the base is an orphan, and the next call writes it again.
    """
    known = live_base(spark, path)
    version = (known[0] if known else 0) + 1
    epochs = [int(x.split("=")[1]) for x in _folders(spark, path) if x.startswith("epoch=")]
    write_base(read_bars(spark, path), path, version)
    publish_base(spark, path, version, max(epochs, default=known[1] if known else -1))
    return version


def write_base(bars: DataFrame, path: str, version: int) -> None:
    rows = bars.withColumn("month", F.date_format("ts", "yyyy-MM")).repartition("symbol", "month").sortWithinPartitions("symbol", "month", "ts")
    rows.write.mode("overwrite").partitionBy("symbol", "month").parquet(f"{path}.base/{version}")


def publish_base(spark: SparkSession, path: str, version: int, epoch: int) -> None:
    spark.range(1).select(F.lit(version).alias("version"), F.lit(epoch).alias("epoch")).coalesce(1).write.mode("overwrite").json(f"{path}.manifest/{version}")


def month_rows(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """(month, n): at least so many distinct bars of a symbol a month, from row counts of files; no column is read."""
    known = live_base(spark, path)
    layers = []
    if known:
        layers.append(spark.read.schema(STORED).parquet(f"{path}.base/{known[0]}").select("symbol", "month", F.lit(known[1]).alias("epoch")))
    if any(int(x.split("=")[1]) > (known[1] if known else -1) for x in _folders(spark, path) if x.startswith("epoch=")):
        schema = T.StructType([*STORED.fields, T.StructField("epoch", T.LongType())])
        rows = spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("epoch") > (known[1] if known else -1))
        layers.append(rows.select("symbol", "month", "epoch"))
    per = reduce(DataFrame.unionByName, layers).where(F.col("symbol") == symbol).groupBy("month", "epoch").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("month").agg(F.max("n").alias("n"))


def slice_since(spark: SparkSession, path: str, symbol: str, rows: int) -> str | None:
    """First month from which on a symbol has at least ``rows`` bars, or None where it never had so many."""
    total = 0
    for r in month_rows(spark, path, symbol).orderBy(F.desc("month")).toLocalIterator():  # a row a month
        total += r["n"]
        if total >= rows:
            return f"{r['month']}-01"
    return None


def signal_slice(spark: SparkSession, path: str, symbol: str, names: list[str], n: int) -> DataFrame:
    """A trailing slice of bars long enough for the predicates of ``names`` on its last ``n`` bars.

    The lookback follows from the expressions and becomes a date bound of the read; where an expression remembers the
    whole series, or the series is shorter, all of it is read.
    """
    reach = atoms.lookback(names)
    since = None if reach is None else slice_since(spark, path, symbol, reach + n)
    return read_bars(spark, path, symbol, since)


def read_bars(spark: SparkSession, path: str, symbol: str | None = None, since=None, until=None) -> DataFrame:
    """Newest bar per (symbol, ts); symbol and months prune folders, ts reaches the scan.

    With a live base and no epoch after it this is a plain scan. Later epochs are merged by key.
    """
    known = live_base(spark, path)
    after = known[1] if known else -1
    newer = any(int(x.split("=")[1]) > after for x in _folders(spark, path) if x.startswith("epoch="))
    base = None
    if known:
        base = _ranged(spark.read.schema(STORED).parquet(f"{path}.base/{known[0]}"), symbol, since, until).select(*BAR.fieldNames())
        if not newer:
            return base
    schema = T.StructType([*STORED.fields, T.StructField("epoch", T.LongType())])
    rows = spark.read.schema(schema).option("basePath", path).parquet(path)
    if known:
        rows = rows.where(F.col("epoch") > after)
    rows = _ranged(rows, symbol, since, until).drop("month")
    if base is not None:
        rows = rows.unionByName(base.withColumn("epoch", F.lit(after).cast("long")))
    return keep_latest(rows, ["symbol", "ts"], "epoch").select(*BAR.fieldNames())


def _ranged(rows: DataFrame, symbol: str | None, since, until) -> DataFrame:
    if symbol is not None:
        rows = rows.where(F.col("symbol") == symbol)
    kind = T.TimestampNTZType()
    if since is not None:
        rows = rows.where((F.col("ts") >= F.lit(since).cast(kind)) & (F.col("month") >= str(since)[:7]))
    if until is not None:
        rows = rows.where((F.col("ts") < F.lit(until).cast(kind)) & (F.col("month") <= str(until)[:7]))
    return rows


def tail(spark: SparkSession, path: str, symbol: str, n: int) -> DataFrame:
    return newest_rows(read_bars(spark, path, symbol), n).orderBy("ts")


def rows_from_json(lines: DataFrame, col: str = "value") -> DataFrame:
    """``[ms, o, h, l, c(, v)]`` JSON rows as typed bars."""
    a = F.from_json(col, "array<double>")
    at = F.timestamp_millis(F.get(a, F.lit(0)).cast("long")).cast("timestamp_ntz")
    cols = [F.get(a, F.lit(k + 1)).alias(x) for k, x in enumerate(("o", "h", "l", "c", "v"))]
    keep = [c for c in lines.columns if c != col]
    return lines.select(*keep, at.alias("ts"), *cols)


def rows_to_arrays(bars: DataFrame) -> DataFrame:
    """Typed bars back to ``[ms, o, h, l, c, v]`` rows."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")).cast("double")
    return bars.select("symbol", F.array(ms, "o", "h", "l", "c", "v").alias("row"))


def manifest(bars: DataFrame, pinned_day=None) -> DataFrame:
    """Rows, bounds and a content hash per symbol, over bars before the pinned UTC day.

    Hashes are per (symbol, day) and then over the days' hashes, so no task
    ever holds a symbol's whole history.
    """
    rows = bars
    if pinned_day is not None:
        rows = bars.where(F.col("ts") < F.lit(pinned_day).cast("timestamp_ntz"))
    line = F.concat_ws(",", F.col("ts").cast("string"), *[F.col(x).cast("string") for x in ("o", "h", "l", "c")])
    days = rows.groupBy("symbol", F.to_date("ts").alias("d")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h"),
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"),
    )
    return days.groupBy("symbol").agg(
        F.sum("n").alias("bars"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"),
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", "h"))), lambda x: x["h"]), "\n"), 256).alias("sha256"),
    )


def install(bars: DataFrame, expected: DataFrame, path: str, epoch: int) -> None:
    """Store a snapshot only when every symbol's hash matches its manifest."""
    got = manifest(bars)
    bad = expected.join(got.select("symbol", F.col("sha256").alias("got")), "symbol", "full_outer").where(
        ~F.col("sha256").eqNullSafe(F.col("got"))
    )
    names = [r["symbol"] for r in bad.limit(5).collect()]
    if names:
        raise ValueError(f"snapshot does not match its manifest: {names}")
    write_epoch(bars, path, epoch)


def pinned(bars: DataFrame) -> DataFrame:
    """Bars before the UTC day of each symbol's newest bar."""
    edge = bars.groupBy("symbol").agg(F.to_date(F.max("ts")).cast("timestamp_ntz").alias("_edge"))
    return bars.join(broadcast_if_small(edge), "symbol").where("ts < _edge").drop("_edge")


def publish_days(days: DataFrame, path: str) -> DataFrame:
    """Write completed daily bars and return their metadata rows."""
    days.write.mode("overwrite").partitionBy("symbol").parquet(path)
    return read_days(days.sparkSession, path).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("days"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def is_warm(meta: DataFrame, start: str, slack_days: int = 2) -> DataFrame:
    """The series reaches back to its listing day."""
    return meta.select("symbol", (F.col("first_day") <= F.date_add(F.lit(start).cast("date"), slack_days)).alias("warm"))


def assert_history(days: DataFrame, start: str, slack_days: int = 2) -> DataFrame:
    """Days unchanged; a series that starts late fails the job."""
    first = days.groupBy("symbol").agg(F.min("day").alias("_f"))
    ok = F.assert_true(F.col("_f") <= F.date_add(F.lit(start).cast("date"), slack_days), F.lit("series does not reach its listing day"))
    return days.join(broadcast_if_small(first), "symbol").where(ok.isNull()).drop("_f")


# --- the versioned tables of accounts -------------------------------------------

TABLES = {"trades": TRADES, "decisions": DECISIONS, "equity_snapshots": SNAPSHOTS}


def write_rows(rows: DataFrame, path: str, table: str, epoch: int) -> None:
    """Add or replace one epoch of a table; columns and types are the table's."""
    schema = T.StructType.fromDDL(TABLES[table])
    rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]).write.mode("overwrite").parquet(f"{path}/{table}/epoch={epoch}")


def read_rows(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Newest row per id of a table; equity points, which have none, as they were appended."""
    schema = T.StructType([*T.StructType.fromDDL(TABLES[table]).fields, T.StructField("epoch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{path}/{table}")
    return rows.drop("epoch") if table == "equity_snapshots" else keep_latest(rows, ["id"], "epoch").drop("epoch")


def append_log(rows: DataFrame, path: str, epoch: int) -> None:
    """Add or replace one epoch of an evaluation log."""
    rows.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """All rows of a log with their epoch, which decides between rows of one time."""
    return spark.read.parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Market snapshot document: ``{closes: {symbol: [..]}, dominance: [..], funding: {symbol: rate}}``."""
    return spark.read.schema(
        "closes map<string,array<double>>, dominance array<double>, funding map<string,double>"
    ).option("multiLine", True).json(path)
