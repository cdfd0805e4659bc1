"""Exact deduplication as a stateful stream whose keyed state never expires.

Documents arrive as narrow rows (digest of the normalised text, identifier, locator). A streaming
aggregation keyed by the digest keeps, on disk (RocksDB) and without a watermark, the smallest
identifier seen, its content locator and the number of arrivals. Equal digests are only hits:
the full bytes of all hits of a digest are compared, and digests under which different texts meet are grouped anew by the text itself.

Texts are equal when identical after each run of ``[\\x20\\x09-\\x0D]`` became one space. A null text
is an empty text. A null identifier sorts after all others. Of rows with equal text and equal
identifier one stays. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylint.functions.staging import shared_folder, stage

#: State on disk; files take the room of their content, as each partition of the state has its own.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def arrivals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The narrow rows that enter the stream: id, row, locator, digest."""
    return docs.select(
        F.col(doc_id).alias("id"),
        F.monotonically_increasing_id().alias("row"),
        F.input_file_name().alias("locator"),
        F.sha2(normalised(F.col(text)), 256).alias("digest"),
    )


def keyed_state(stream: DataFrame) -> DataFrame:
    """Streaming aggregation: per digest the arrival that stays and the number of arrivals."""
    first = F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "row", "locator"))
    return stream.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("arrived"))


def consume(stream: DataFrame, checkpoint: str) -> DataFrame:
    """Feed all rows the stream has now into the state below ``checkpoint`` and return the state.

    Called again with the same checkpoint, only new rows are read: the state goes on from there.
    """
    spark = stream.sparkSession
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)
    try:
        (
            keyed_state(stream)
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    state = spark.read.format("statestore").load(checkpoint)
    # The value holds the aggregation buffers in the order of the aggregates.
    first, arrived = (F.col("value")[name] for name in state.schema["value"].dataType.names)
    return state.select(
        F.col("key")["digest"].alias("digest"),
        first["id"].alias("keep_id"),
        first["row"].alias("keep_row"),
        first["locator"].alias("keep_locator"),
        arrived.alias("group_size"),
    )


@dataclass(frozen=True)
class Deduplicated:
    """``rows``: id, digest, keep_id, group_size, kept; one per document."""

    rows: DataFrame
    state: DataFrame


def different_bytes(docs: DataFrame, rows: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts of all groups whose digest stands for different bytes: id, digest, content.

    All contents of a group are equal if its smallest and largest are, byte by byte.
    """
    hits = rows.where("group_size > 1").select("id", "digest").distinct()
    content = normalised(F.col(text))
    texts = docs.select(F.col(doc_id).alias("own"), content.alias("content"), F.sha2(content, 256).alias("sha"))
    hit_texts = texts.join(
        hits, F.col("own").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("digest"))
    ).select("id", "digest", "content")
    unequal = (
        hit_texts.groupBy("digest").agg(F.min("content").alias("low"), F.max("content").alias("high"))
        .where("low <> high").select("digest")
    )
    return hit_texts.join(unequal, "digest")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> Deduplicated:
    """Run all of ``docs`` through the stream and check every hit by its bytes."""
    spark = docs.sparkSession
    base = f"{folder or shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    arrived = stage(arrivals(docs, doc_id, text), "arrivals", base)
    source = arrived.inputFiles()
    state = _state_of(spark, arrived, source, base)
    joined = arrived.join(state, "digest", "left")
    rows = stage(
        joined.select(
            "id", "digest", "keep_id", "group_size",
            (F.col("row") == F.col("keep_row")).alias("kept"),
        ),
        "rows", base,
    )
    collided = stage(different_bytes(docs, rows, doc_id, text), "collided", base)
    if collided.isEmpty():
        return Deduplicated(rows, state)
    return Deduplicated(_regrouped(rows, collided), state)


def _state_of(spark: SparkSession, arrived: DataFrame, files: list[str], base: str) -> DataFrame:
    if not files:
        return spark.createDataFrame(
            [], "digest string, keep_id bigint, keep_row bigint, keep_locator string, group_size bigint"
        )
    stream = spark.readStream.schema(arrived.schema).parquet(files[0].rsplit("/", 1)[0])
    return consume(stream, f"{base}/stream")


def _regrouped(rows: DataFrame, collided: DataFrame) -> DataFrame:
    """Decisions for digests that stand for several texts, by the texts themselves."""
    same = Window.partitionBy("digest", "content")
    order = same.orderBy(F.col("id").isNull(), "id")
    again = collided.select(
        "id", "digest",
        F.first("id").over(order).alias("keep_id"),
        F.count(F.lit(1)).over(same).alias("group_size"),
        (F.row_number().over(order) == 1).alias("kept"),
    )
    return rows.join(collided.select("digest").distinct(), "digest", "left_anti").select(again.columns).unionByName(again)


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """``docs`` without the rows that repeat a text, all columns as they were."""
    kept = deduplicate(docs, doc_id, text, folder).rows.where("kept").select("id", "digest")
    rows = docs.select(
        F.struct("*").alias("doc"), F.col(doc_id).alias("own"), F.sha2(normalised(F.col(text)), 256).alias("sha")
    )
    same = F.col("own").eqNullSafe(F.col("id")) & (F.col("sha") == F.col("digest"))
    place = Window.partitionBy("own", "sha").orderBy(F.lit(1))
    return (
        rows.join(kept, same, "left_semi")
        .withColumn("place", F.row_number().over(place))
        .where("place = 1").select("doc.*")
    )
