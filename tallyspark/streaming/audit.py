"""Structured Streaming over the audit log and uploads, with the batch forms that they must equal."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyspark.functions.dates import month
from tallyspark.functions.shared import new_folder, saved
from tallyspark.operators.detection import flag_critical


def event_stream(spark: SparkSession, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events*.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def run_now(stream: DataFrame, keys: list[str], mode: str = "update") -> DataFrame:
    """Runs a stream over what there is; of rows with one key the newest batch's counts. Each batch is
    written under its number, so that one that is run again replaces itself."""
    spark = stream.sparkSession
    base = new_folder(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/out/run={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out").drop("run")
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))
    return (out.withColumn("r", newest).where("r = 1") if keys else out).drop("r", "batch")


def sliding_counts(events: DataFrame, window: str = "1 hour", slide: str | None = "10 minutes", late: str = "1 day") -> DataFrame:
    """Actions per user and sliding window; without slide the windows tumble."""
    span = F.window("ts", window, slide) if slide else F.window("ts", window)
    counted = (events.withWatermark("ts", late) if events.isStreaming else events).groupBy(span.alias("w"), "user_id", "action").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "action", "n")


def unique_uploads(uploads: DataFrame, late: str = "40 days") -> DataFrame:
    """One upload per person and digest within the watermark."""
    marked = uploads.withWatermark("ts", late)
    return marked.dropDuplicatesWithinWatermark(["person_id", "sha256"]) if uploads.isStreaming else uploads.dropDuplicates(["person_id", "sha256"])


def running_totals(tx: DataFrame) -> DataFrame:
    """Totals by person, month and type, updated as transactions arrive."""
    return tx.groupBy("person_id", month(F.to_date("ts")).alias("month"), "type").agg(F.sum("amount").cast("decimal(19,2)").alias("total"), F.count("*").alias("n"))


#: What a corrected row counts in: AG3's key, the category, and whether it is critical.
CELL = ["person_id", "month", "type", "category", "critical"]
_CHANGE = "tx_id string, version bigint, person_id bigint, transaction_date date, type string, category string, amount decimal(19,2), deleted boolean, critical boolean"
_DELTA = "person_id bigint, month date, type string, category string, critical boolean, total decimal(29,2), n bigint"


class CorrectedTotals:
    """Totals of a stream of changes, kept right when rows are deleted, re-dated or re-categorised.

    A change (tx_id, version, person_id, transaction_date, type, category, amount, deleted; description where critical rows are
    flagged by words) is a row's new state; the newest version of a row counts, in whatever order changes come, equal versions by their values. Each micro-batch writes the new
    states and, by cell, the signed differences they make: what the row counted for is taken back, what it counts for now is added. Both stand
    under the batch's number and are read only by later batches, so a batch that is run again replaces itself. Every `every`
    batches a snapshot gathers all before it, and what the snapshot before has gathered is deleted. Null ids and versions are left out.
    """

    def __init__(self, spark: SparkSession, at: str, every: int = 10) -> None:
        self.spark, self.at, self.every = spark, at, every
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._path = hadoop
        self._fs = hadoop(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        """Of the finished parts of a kind the numbers, ascending."""
        root = self._path(f"{self.at}/{kind}")
        if not self._fs.exists(root):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(root)]
        return sorted(int(n) for n in names if n.isdigit() and self._fs.exists(self._path(f"{self.at}/{kind}/{n}/_SUCCESS")))

    def _before(self, kind: str, number: int, schema: str) -> DataFrame:
        """All parts of a kind with numbers below one: the last snapshot, and the batches after it."""
        snapshots = [n for n in self._numbers(f"{kind}-upto") if n < number]
        since = snapshots[-1] if snapshots else -1
        paths = [f"{self.at}/{kind}-upto/{since}"] if snapshots else []
        paths += [f"{self.at}/{kind}/{n}" for n in self._numbers(kind) if since < n < number]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _newest(self, changes: DataFrame) -> DataFrame:
        rest = [f.name for f in StructType.fromDDL(_CHANGE) if f.name not in ("tx_id", "version")]
        return changes.groupBy("tx_id").agg(F.max(F.struct("version", *rest)).alias("c")).select("tx_id", "c.*")

    def apply(self, changes: DataFrame, number: int) -> None:
        """Takes a micro-batch in; for foreachBatch."""
        names = [f.name for f in StructType.fromDDL(_CHANGE)]
        new = self._newest(changes.where("tx_id is not null and version is not null").select(*names))
        known = self._before("rows", number, _CHANGE)
        old = self._newest(known.join(new.select("tx_id"), "tx_id", "left_semi"))
        before = old.select("tx_id", F.struct(*[c for c in names if c != "tx_id"]).alias("before"))
        changed = new.join(before, "tx_id", "left").where("before is null or version > before.version")
        changed = self._write(changed, f"rows-changed/{number}")
        self._write(changed.select(*names), f"rows/{number}")
        taken = changed.where("before is not null").select("before.*").withColumn("sign", F.lit(-1))
        both = changed.drop("before", "tx_id").withColumn("sign", F.lit(1)).unionByName(taken).where("not coalesce(deleted, false)")
        cells = both.groupBy("person_id", month(F.col("transaction_date")).alias("month"), "type", "category", "critical").agg(F.sum(F.col("amount") * F.col("sign")).cast("decimal(29,2)").alias("total"), F.sum("sign").cast("bigint").alias("n"))
        self._write(cells.where("n <> 0 or total <> 0"), f"deltas/{number}")
        if number % self.every == self.every - 1:
            self._write(self._newest(self._before("rows", number + 1, _CHANGE)).select(*names), f"rows-upto/{number}")
            self._write(self._cells(self._before("deltas", number + 1, _DELTA)), f"deltas-upto/{number}")
            self._forget(number)

    def _cells(self, deltas: DataFrame) -> DataFrame:
        return deltas.groupBy(*CELL).agg(F.sum("total").cast("decimal(29,2)").alias("total"), F.sum("n").alias("n"))

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def _forget(self, number: int) -> None:
        """Deletes what only batches before the last snapshot but one would read; the batch itself may be run again."""
        for kind in ("rows", "deltas"):
            kept = [n for n in self._numbers(f"{kind}-upto") if n < number]
            if kept:
                gone = [f"{kind}-upto/{n}" for n in kept[:-1]] + [f"{kind}/{n}" for n in self._numbers(kind) if n <= kept[-1]]
                for name in [*gone, *([f"rows-changed/{n}" for n in self._numbers("rows-changed") if n <= kept[-1]] if kind == "rows" else [])]:
                    self._fs.delete(self._path(f"{self.at}/{name}"), True)

    def start(self, changes: DataFrame, flags: dict | None = None):
        """The running query. flags: the options of detection.flag_critical, which marks rows as they come; without it
        none is critical unless the changes say so."""
        return flagged(changes, flags).writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.at}/checkpoint").trigger(availableNow=True).start()

    def cells(self) -> DataFrame:
        """(person_id, month, type, category, critical, total, n) as of the last finished batch; cells that hold nothing are left out."""
        return self._cells(self._before("deltas", 1 << 62, _DELTA)).where("n > 0").withColumn("total", F.col("total").cast("decimal(19,2)"))

    def totals(self) -> DataFrame:
        """The cells summed to what summaries.month_type_totals gives, with the number of critical rows."""
        return self.cells().groupBy("person_id", "month", "type").agg(F.sum("total").cast("decimal(19,2)").alias("total"), F.sum("n").alias("n"), F.sum(F.when(F.col("critical"), F.col("n")).otherwise(0)).alias("n_critical"))


def flagged(changes: DataFrame, flags: dict | None) -> DataFrame:
    """Changes, streamed or not, with critical as detection.flag_critical has it."""
    if flags is not None:
        given = changes if "description" in changes.columns else changes.withColumn("description", F.lit(""))
        return flag_critical(given, **flags).withColumn("critical", F.col("is_critical"))
    return changes if "critical" in changes.columns else changes.withColumn("critical", F.lit(False))


def _slice(column: str, us: int) -> Column:
    return F.expr(f"({column} - pmod({column}, {us})) div {us}")


def _first_not_before(times: DataFrame, us: int) -> DataFrame:
    """(key, slice, t, next, next_slice) of the different times (key, slice, t) of events: the first one that is us or more later.
    Slices are us long, so it is in the slice after, or else the first of a later one."""
    asked = times.select("key", (F.col("slice") + 1).alias("slice"), (F.col("t") + us).alias("at"), F.col("t").alias("of"), F.lit(None).cast("bigint").alias("event"))
    both = asked.unionByName(times.select("key", "slice", F.col("t").alias("at"), F.lit(None).cast("bigint").alias("of"), F.col("t").alias("event")))
    down = Window.partitionBy("key", "slice").orderBy(F.desc("at"), F.desc_nulls_last("event")).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("here", F.last("event", ignorenulls=True).over(down))
    firsts = both.groupBy("key", "slice").agg(F.min("event").alias("first"))  # a row a slice
    later = Window.partitionBy("key").orderBy("slice").rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select("key", "slice", F.first("first", ignorenulls=True).over(later).alias("after"))
    out = here.where("of is not null").join(firsts, ["key", "slice"]).select("key", (F.col("slice") - 1).alias("slice"), F.col("of").alias("t"), F.coalesce("here", "after").alias("next"))
    return out.withColumn("next_slice", _slice("next", us))


def _sliced_anchors(times: DataFrame, us: int) -> DataFrame:
    """(key, anchor) for keys of any size: windows over slices of time, composed as maps.

    A slice as long as a window holds one anchor at most. Its map leads from each event that may be its anchor to the anchor that
    follows it. Two neighbouring blocks of slices make one of twice the length, whose map needs only the events by which a block is entered:
    those of its first slice, and the first one after that. So each level has half the rows of the one below, and log2 of the number of
    slices levels are enough. Back down, the anchor by which a block is entered gives those of its halves. No task has more than a slice of a key."""
    low, high = times.agg(F.min("slice"), F.max("slice")).first()
    if low is None:
        return times.select("key", F.col("t").alias("anchor"))
    maps = [saved(_first_not_before(times, us).withColumns({"slice": F.col("slice") - low, "next_slice": F.col("next_slice") - low}), "quota-slices")]
    firsts = saved(maps[0].groupBy("key", "slice").agg(F.min("t").alias("t")), "quota-firsts")
    level = 0
    while (high - low) >> level:
        now, size = maps[-1], 2 << level
        inner = firsts.where(f"slice % {size} <> 0").groupBy("key", F.expr(f"slice div {size}").alias("b")).agg(F.min("t").alias("t")).select("key", "t")
        # the first event after a block's first slice is its entry where that slice has none late enough
        entries = now.where(f"slice % {size} = 0").unionByName(now.where(f"slice % {size} <> 0").join(inner, ["key", "t"], "left_semi"))
        half = lambda c: f"({c} div {size // 2})"
        further = now.select("key", F.col("t").alias("next"), F.col("next").alias("then"), F.col("next_slice").alias("then_slice"))
        inside = F.expr(f"{half('slice')} % 2 = 0 and {half('next_slice')} = {half('slice')} + 1")
        joined = entries.withColumn("inside", F.coalesce(inside, F.lit(False))).join(further, ["key", "next"], "left")
        maps.append(saved(joined.select("key", "slice", "t", F.when(F.col("inside"), F.col("then")).otherwise(F.col("next")).alias("next"), F.when(F.col("inside"), F.col("then_slice")).otherwise(F.col("next_slice")).alias("next_slice")), "quota-slices"))
        level += 1
    found = firsts.groupBy("key").agg(F.min(F.struct("t", "slice")).alias("e")).select("key", "e.t", "e.slice")
    for k in range(level - 1, -1, -1):
        size = 1 << k
        enters = F.expr(f"(slice div {size}) % 2 = 0 and next_slice div {size} = slice div {size} + 1")
        second = found.join(maps[k].drop("slice"), ["key", "t"]).where(enters).select("key", F.col("next").alias("t"), F.col("next_slice").alias("slice"))
        found = found.unionByName(second)
        if k % 4 == 0:
            found = saved(found, "quota-anchors")
    return found.select("key", F.col("t").alias("anchor"))


#: A key with more different times is cut into slices of time; below, its times are one array.
FOLDED = 10_000


def quota(events: DataFrame, key: str, limit: int = 20, seconds: int = 3600, folded: int = FOLDED) -> DataFrame:
    """(event_id, key, allowed): a window of fixed length begins at a key's first event, and at the first one
    after it ended; events beyond the limit are rejected, by time and id. Null keys and times have no windows and no rows.

    Keys of few different times find their windows in a fold over an array, others over slices of time; then each event has its window from
    its slice, which holds one beginning at most, and is ranked in it. Only built-in functions."""
    us = seconds * 1_000_000
    rows = events.select("event_id", F.col(key).cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).where("key is not null and us is not null")
    rows = rows.withColumn("slice", _slice("us", us))
    times = rows.groupBy("key", "slice", F.col("us").alias("t")).agg(F.count("*").alias("n")).drop("n")
    sizes = times.groupBy("key").agg(F.count("*").alias("n"))
    heavy = saved(sizes.where(F.col("n") > folded).select("key"), "quota-heavy")
    step = f"(s, t) -> if(s.ends is null or t >= s.ends, named_struct('ends', t + {us}L, 'anchors', array_append(s.anchors, t)), s)"
    fold = F.expr(f"aggregate(array_sort(ts), named_struct('ends', cast(null as bigint), 'anchors', cast(array() as array<bigint>)), {step}, s -> s.anchors)")
    anchors = times.join(heavy, "key", "left_anti").groupBy("key").agg(F.collect_list("t").alias("ts")).select("key", F.explode(fold).alias("anchor"))
    if not heavy.isEmpty():
        anchors = anchors.unionByName(_sliced_anchors(saved(times.join(heavy, "key", "left_semi"), "quota-times"), us))
    # a row for each slice of a key: its own beginning, and the last one before it
    slices = rows.select("key", "slice").distinct().join(anchors.withColumn("slice", _slice("anchor", us)), ["key", "slice"], "left")
    before = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.last("anchor", ignorenulls=True).over(before))
    placed = rows.join(slices, ["key", "slice"]).withColumn("anchor", F.when(F.col("anchor") <= F.col("us"), F.col("anchor")).otherwise(F.col("before")))
    turn = F.row_number().over(Window.partitionBy("key", "anchor").orderBy("us", "event_id"))
    return placed.select("event_id", "key", (turn <= limit).alias("allowed"))


def quota_stream(events: DataFrame, key: str, limit: int = 20, seconds: int = 3600) -> DataFrame:
    """The same on a stream: a state of window start and count for each key, dropped by a timer when its window is over."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Quota(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("window", "anchor bigint, used bigint")

        def handleInputRows(self, key, rows, timerValues):
            anchor, used = self.state.get() if self.state.exists() else (None, 0)
            out = []
            for r in pd.concat(list(rows)).sort_values(["us", "event_id"]).itertuples():
                if anchor is None or r.us >= anchor + seconds * 1_000_000:
                    anchor, used = r.us, 0
                    self.handle.registerTimer((anchor // 1000) + seconds * 1000)
                used += 1
                out.append((r.event_id, key[0], used <= limit))
            self.state.update((int(anchor), int(used)))
            yield pd.DataFrame(out, columns=["event_id", "key", "allowed"])

        def handleExpiredTimer(self, key, timerValues, expired):
            if self.state.exists() and expired.getExpiryTimeInMs() >= self.state.get()[0] // 1000 + seconds * 1000:
                self.state.clear()
            yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "key": pd.Series(dtype="str"), "allowed": pd.Series(dtype="bool")})

        def close(self) -> None:
            pass

    rows = events.withWatermark("ts", "1 hour").select("event_id", F.col(key).cast("string").alias("key"), "ts", F.unix_micros("ts").alias("us"))
    return rows.groupBy("key").transformWithStateInPandas(Quota(), outputStructType="event_id bigint, key string, allowed boolean", outputMode="append", timeMode="eventTime")
