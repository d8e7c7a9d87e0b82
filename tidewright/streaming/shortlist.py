"""The shortlist filter as a stream: a state for each series, kept between batches and across restarts.

Rows of a series must come in the order of t, cut into batches in any way; the scores are those of the batch form. What is
kept has a fixed size whatever the series' length. A series that stays silent is forgotten by a timer, if one is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewright import stage
from tidewright.operators.hmm import Shortlist

ROWS = "series_id int, t long, obs int, normal array<double>"
SCORES = "series_id int, t long, score double, candidate int"
STATE = "state array<double>, counts array<double>, active array<int>, seen long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ShortlistProcessor(StatefulProcessor):
    """settings: of Shortlist.new; silence: milliseconds after which a series without rows is forgotten."""

    def __init__(self, matrix: np.ndarray, settings: dict, silence: int | None = None):
        self.matrix, self.settings, self.silence = matrix, settings, silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("shortlist", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("t", kind="stable")
        if not len(batch):
            return
        own = Shortlist.new(self.matrix, np.array(batch["normal"].iloc[0], float), **self.settings)
        if self.kept.exists():
            state, counts, active, seen = self.kept.get()
            own.state, own.counts, own.active, own.seen = np.array(state, float).reshape(-1, 2), np.array(counts, float), np.array(active, int), seen
        score, best = own.feed(batch["obs"])
        self.kept.update((own.state.ravel().tolist(), own.counts.tolist(), own.active.tolist(), own.seen))
        if self.silence is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.silence)
        yield pd.DataFrame({"series_id": batch["series_id"].to_numpy(), "t": batch["t"].to_numpy(), "score": score, "candidate": best})

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        yield pd.DataFrame({c.split(" ")[0]: [] for c in SCORES.split(", ")})

    def close(self) -> None:
        pass


def scores(stream: DataFrame, matrix: np.ndarray, settings: dict, silence: int | None = None) -> DataFrame:
    """SCORES for a stream of ROWS; normal: the chances of the reports of a normal series."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    processor = ShortlistProcessor(matrix, settings, silence)
    return stream.groupBy("series_id").transformWithStateInPandas(processor, SCORES, "Append", "processingTime" if silence is not None else "None")


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).parquet(path)


def write(found: DataFrame, folder: str):
    """Runs a stream of scores to the end of its source; an epoch that runs again replaces its own rows."""

    def store(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/scores/epoch={epoch}")

    return found.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def replay(rows: DataFrame, matrix: np.ndarray, settings: dict, parts: int = 4) -> DataFrame:
    """SCORES of a table of ROWS, sent through the stream in slices of t; after each the query stops and is started anew."""
    spark, folder = rows.sparkSession, f"{stage.folder(rows.sparkSession).rstrip('/')}/shortlist-{uuid4().hex}"
    rows = stage.table(rows.select(*[F.col(x.split(" ")[0]).cast(x.split(" ")[1]) for x in ROWS.split(", ")]), "reports")
    last = rows.agg(F.max("t")).first()[0]
    for k in range(parts if last is not None else 0):
        own = rows.where((F.col("t") * parts / F.lit(last + 1) >= k) & (F.col("t") * parts / F.lit(last + 1) < k + 1))
        own.repartition("series_id").write.mode("append").parquet(f"{folder}/reports")
        write(scores(source(spark, f"{folder}/reports", 1_000_000), matrix, settings), folder).awaitTermination()
    if last is None:
        return spark.createDataFrame([], SCORES)
    return spark.read.schema(SCORES).parquet(f"{folder}/scores").select(*[x.split(" ")[0] for x in SCORES.split(", ")])
