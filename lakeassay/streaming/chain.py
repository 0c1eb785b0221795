"""A hash-chained log kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeassay.operators.provenance import CHAIN, build_chains
from lakeassay.session import ship_package


def append_stream(source: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, late_path: str | None = None) -> StreamingQuery:
    """Append each micro-batch of (chain_id, seq, payload, timestamp) to the chained log at ``path``.

    Chains go on from their stored heads.  A record whose chain and sequence
    number are stored already is a redelivery (Spark repeats a batch after a
    failure) and is not chained twice.  Any other record at or below its chain's
    head came too late to be chained: it is written to ``late_path`` (the log's
    path with ``_late`` appended, unless given), with the batch it came in.
    """
    spark = source.sparkSession
    ship_package(spark)
    late_path = late_path or path.rstrip("/") + "_late"

    def write(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        hadoop = s._jvm.org.apache.hadoop.fs.Path(path)
        stored = s.read.schema(CHAIN).parquet(path) if hadoop.getFileSystem(s._jsc.hadoopConfiguration()).exists(hadoop) else s.createDataFrame([], CHAIN)
        heads = stored.groupBy("chain_id").agg(F.max("seq").alias("last_seq"), F.max_by("record_hash", "seq").alias("head"))
        rows = batch.select("chain_id", "seq", "payload", "timestamp").join(heads, "chain_id", "left")
        old = rows.where(F.col("seq") <= F.col("last_seq")).join(stored.select("chain_id", "seq"), ["chain_id", "seq"], "left_anti")
        late = old.select("chain_id", "seq", "payload", "timestamp", F.lit(batch_id).alias("batch_id"))
        if not late.isEmpty():
            late.write.mode("append").parquet(late_path)
        fresh = rows.where(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq")))
        build_chains(fresh, head="head").write.mode("append").parquet(path)

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


__all__ = ["append_stream"]
