"""A stream of document versions.

New files in a folder are extracted as they arrive. State for each standard is the highest sequence
number seen: a version that comes late (not above it) goes to quarantine and changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from clausework.operators.extract import extract

ARRIVAL = "standard string, seq long, document_version string, html string"
VERDICT = "standard string, seq long, document_version string, html string, late boolean"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines of ARRIVAL's columns, as files arrive."""
    return spark.readStream.schema(ARRIVAL).json(folder)


def judge(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
    last = state.get[0] if state.exists else None
    late = []
    for seq in rows["seq"]:
        late.append(last is not None and seq <= last)
        last = seq if last is None else max(last, seq)
    state.update((int(last),))
    yield rows.assign(late=late)


def ordered(stream: DataFrame) -> DataFrame:
    """The stream's versions, each with whether it came late."""
    return stream.groupBy("standard").applyInPandasWithState(judge, VERDICT, "last long", "append", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, folder: str, out: str, checkpoint: str, profile: str = "rfc2119"):
    """Requirements of the versions in order go to out/requirements, late versions to out/quarantine. Stops when the folder is exhausted."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("document_sha256", F.sha2("html", 256)).persist()
        extract(batch.where("not late"), profile).write.mode("overwrite").parquet(f"{out}/requirements/batch={number}")
        batch.where("late").select("standard", "seq", "document_version", "document_sha256").write.mode("overwrite").parquet(f"{out}/quarantine/batch={number}")
        batch.unpersist()

    return ordered(arrivals(spark, folder)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
