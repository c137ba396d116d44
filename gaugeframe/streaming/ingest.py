"""New run reports as they arrive: facts appended, summaries kept current.

The streams hold no state in memory. A report is flattened on its own, so a late report is never
dropped; one that is sent again replaces its leaf in the table of summaries, which is kept in
hash buckets of which a batch rewrites those it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from gaugeframe.functions.columns import col, cols, null_safe_join
from gaugeframe.operators.runs import leaf_summary
from gaugeframe.sources.readers import place_in_tree


def report_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    levels: Sequence[str] | None = None,
    multi_line: bool = True,
    max_files: int = 10_000,
) -> DataFrame:
    """Stream of reports under a path (globs allowed); ``levels`` adds the tree columns of each file."""
    reader = spark.readStream.schema(schema).option("multiLine", multi_line).option("mode", "FAILFAST")
    reports = reader.option("maxFilesPerTrigger", max_files).json(path)
    sent = F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("file"))
    reports = reports.select("*", sent.alias("sent"))
    if levels is None:
        return reports
    return place_in_tree(reports.withColumn("__file", F.col("sent.file")), "__file", levels)


def ingest(reports: DataFrame, flatten: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Append the facts of new reports to a table; the file sink's log makes it exactly once."""
    facts = flatten(reports)
    writer = facts.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)


BUCKETS = 64
LEAVES_A_TASK = 500_000
TASKS_A_SPLIT = 4


def _slots(spark: SparkSession, log: str, before: int | None = None) -> dict[int, int]:
    """Which of its two slots each bucket is in, after the last batch (before a given one); at most a row per bucket is read."""
    try:
        rows = spark.read.parquet(f"{log}/current/*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return {}
    rows = rows if before is None else rows.where(F.col("batch") < before)
    found = rows.collect()  # two lists of buckets at most
    last = max((r["batch"] for r in found), default=None)
    return {r["bucket"]: r["slot"] for r in found if r["batch"] == last}


def _kept(spark: SparkSession, log: str, slots: Mapping[int, int]) -> DataFrame | None:
    """The leaves of these buckets; other buckets and slots are not read."""
    if not slots:
        return None
    rows = spark.read.parquet(f"{log}/leaves")
    places = [(F.col("slot") == slot) & F.col("bucket").isin([b for b, s in slots.items() if s == slot]) for slot in sorted(set(slots.values()))]
    return rows.where(reduce(lambda a, b: a | b, places)).drop("slot")


def merge_batch(leaves: DataFrame, log: str, number: int, leaf: str = "leaves", buckets: int = BUCKETS) -> None:
    """Put the leaf summaries of a batch in place of those that are kept.

    The table is dealt to hash buckets, each with two slots. A batch reads and rewrites only the buckets that it touches,
    into the slot that isn't in use, and then writes the list of slots in use, to one of two places in turn. Until that is done
    readers see the state before. A batch that is run again, after a failure between the two writes or after both, finds the list of
    the batch before it and does the same again. A bucket of many leaves is dealt to several tasks, a file each.
    """
    spark = leaves.sparkSession
    new = leaves.withColumn("bucket", F.pmod(F.xxhash64(col(leaf)), F.lit(buckets)).cast("int")).persist()
    try:
        before = _slots(spark, log, number)
        sized = lambda rows: {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}  # at most ``buckets``
        touched = sized(new)
        if touched:
            kept = _kept(spark, log, {b: before[b] for b in touched if b in before})
            held = {} if kept is None else sized(kept)
            pieces = 1 + max(n + held.get(b, 0) for b, n in touched.items()) // LEAVES_A_TASK
            piece = F.pmod(F.hash(col(leaf)), F.lit(pieces))
            tasks = len(touched) * pieces
            merged = new if kept is None else kept.repartition(tasks, col(leaf)).join(new.select(col(leaf)), leaf, "left_anti").unionByName(new)
            target = {b: 1 - before.get(b, 1) for b in touched}
            slot = F.create_map(*[F.lit(x) for pair in target.items() for x in pair])[F.col("bucket")]
            writer = merged.withColumn("slot", slot).repartition(tasks, "bucket", piece).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("slot", "bucket").parquet(f"{log}/leaves")
            before = before | target
        state = spark.createDataFrame([(number, b, s) for b, s in sorted(before.items())], "batch bigint, bucket int, slot int")
        state.coalesce(1).write.mode("overwrite").parquet(f"{log}/current/place={number % 2}")
    finally:
        new.unpersist()


def keep_summaries(
    reports: DataFrame,
    flatten: Callable[[DataFrame], DataFrame],
    log: str,
    checkpoint: str,
    leaf: str = "leaves",
    levels: Sequence[str] = (),
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the leaf summaries current: each batch replaces the leaves it brings (see :func:`merge_batch`).

    ``flatten`` keeps the column ``sent``, the time and name of the file. Of two sendings of a
    leaf in one batch only the rows of the later file count, of several batches those of the last.
    """
    def write(batch: DataFrame, number: int) -> None:
        facts = flatten(batch)
        last = facts.groupBy(col(leaf)).agg(F.max("sent").alias("__last"))
        newest = null_safe_join(facts, last, [leaf]).where(F.col("sent") == F.col("__last")).drop("sent", "__last")
        # The tasks of the shuffles follow the splits of the batch. They are not put together by their bytes on disk, which
        # are a small part of what their rows take in memory.
        conf, parts, together = batch.sparkSession.conf, "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"
        usual = {name: conf.get(name) for name in (parts, together)}
        conf.set(parts, str(max(int(usual[parts]), TASKS_A_SPLIT * batch.rdd.getNumPartitions())))
        conf.set(together, "false")
        try:
            merge_batch(leaf_summary(newest, leaf, levels), log, number, leaf, buckets)
        finally:
            for name, value in usual.items():
                conf.set(name, value)

    writer = reports.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def current_leaves(spark: SparkSession, log: str, leaf: str = "leaves") -> DataFrame:
    """The leaf summaries as of the last batch; as many files are read after many batches as after one."""
    rows = _kept(spark, log, _slots(spark, log))
    if rows is None:
        raise ValueError(f"no batch has been written to {log}")
    return rows.drop("bucket")
