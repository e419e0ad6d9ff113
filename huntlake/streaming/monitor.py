"""W1-W4 and W10 on a stream: each micro-batch is scored (W10), its metrics go to a
history table (W1) and are compared with the baseline F1 (W2); a degraded batch either
fills the retraining buffer (W3) or triggers a retrain at once (W4).

History and buffer hold one folder per micro-batch, written as a whole and replaced as a
whole, and the history row comes last. A micro-batch that is replayed after a failure at
any point therefore leaves the same tables as one that went through at once; one already
in the history is skipped. Models carry the id of the micro-batch that trained them.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.operators.metrics import binary_metrics_wide

HISTORY = ("batch long, samples long, accuracy double, precision double, recall double, f1 double, baseline_f1 double, "
           "degraded boolean, buffered_rows long, retrained boolean, model_version long, new_f1 double, "
           "adaptation_time_seconds double")


class StreamMonitor:
    """State lives in tables under ``base_path``: history and buffer.

    ``score(batch, version)`` scores a micro-batch with a model version (None: the first
    model); without it the batch brings its predictions. ``retrain(rows, version)`` fits a
    new model, stores it under the version (replacing a half-written one) and returns its
    F1; without it retrains are recorded and nothing is fitted.

    mode 'buffer': once the degraded batches since the last retrain hold ``buffer_rows``
    rows, the model is fitted on them, the buffer starts anew and the next batch sets the
    baseline. mode 'immediate': every degraded batch retrains on itself and the new F1
    becomes the baseline. A batch without labelled rows leaves no trace.
    """

    def __init__(self, spark: SparkSession, base_path: str, truth: str = "is_apt", pred: str = "apt_prediction",
                 threshold: float = 0.1, buffer_rows: int = 1000, mode: str = "buffer",
                 retrain: Callable[[DataFrame, int], float | None] | None = None,
                 score: Callable[[DataFrame, int | None], DataFrame] | None = None):
        if mode not in ("buffer", "immediate"):
            raise ValueError(f"mode {mode!r} is not one of buffer, immediate")
        self.spark, self.base = spark, base_path.rstrip("/")
        self.truth, self.pred, self.threshold = truth, pred, threshold
        self.buffer_rows, self.mode = buffer_rows, mode
        self.retrain, self.score = retrain, score

    def history(self) -> DataFrame:
        """One row per micro-batch (none before the first)."""
        try:
            return self.spark.read.schema(HISTORY).parquet(f"{self.base}/history/id=*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], HISTORY)

    def _buffered(self, batch_ids: list[int]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.base}/buffer/id={i}" for i in batch_ids])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        past = self.history()
        if not past.where(F.col("batch") == batch_id).isEmpty():
            return
        last = past.where(F.col("batch") < batch_id).orderBy(F.desc("batch")).first()
        cut = past.where(F.col("retrained")).agg(F.max("batch")).first()[0]
        version = cut if self.retrain else None
        scored = self.score(batch, version) if self.score else batch
        m = binary_metrics_wide(scored, self.truth, self.pred).first()
        samples = m["tp"] + m["fp"] + m["tn"] + m["fn"]
        if samples == 0:
            return
        if last is None or (self.mode == "buffer" and last["retrained"]):
            baseline, buffered = m["f1"], 0
        else:
            baseline = last["new_f1"] if last["retrained"] and last["new_f1"] is not None else last["baseline_f1"]
            buffered = 0 if last["retrained"] else last["buffered_rows"]
        degraded = m["f1"] < baseline - self.threshold
        retrained, new_f1, seconds = False, None, None
        if degraded:
            buffered += samples
            batch.write.mode("overwrite").parquet(f"{self.base}/buffer/id={batch_id}")
            retrained = self.mode == "immediate" or buffered >= self.buffer_rows
        if retrained and self.retrain:
            since = past.where(F.col("degraded") & (F.col("batch") > (-1 if cut is None else cut))).select("batch").collect()
            ids = [r[0] for r in since] if self.mode == "buffer" else []  # batches since the last retrain
            t0 = time.time()
            new_f1 = self.retrain(self._buffered([*ids, batch_id]), batch_id)
            seconds = time.time() - t0
        row = (batch_id, samples, m["accuracy"], m["precision"], m["recall"], m["f1"], float(baseline), degraded, buffered,
               retrained, version, new_f1, seconds)
        self.spark.createDataFrame([row], HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{self.base}/history/id={batch_id}")


def start_monitor(stream: DataFrame, monitor: StreamMonitor, checkpoint: str, available_now: bool = True):
    writer = stream.writeStream.foreachBatch(monitor).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def score_stream(model, stream: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Apply a saved PipelineModel to a streaming DataFrame."""
    from huntlake.models.classifier import score
    return score(model, stream, threshold)
