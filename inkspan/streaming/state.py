"""Streams: resumable labelling and per-key training state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.plugins import detect
from ..operators.splits import not_done
from ..sources.labels import append_failures, append_labels, read_done


def label_stream(spark: SparkSession, inbox: str, labels: str, failures: str, checkpoint: str, make: Callable, per_trigger: int = 1000):
    """Labels paths that arrive as lines of text files, once each; returns the started query.

    The checkpoint remembers what was read, so a restarted query goes on where it stopped.  A batch that is
    played again, and a path that arrives again, leave out what the label file holds; failures are tried again.
    """
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", per_trigger).load(inbox)

    def write(batch: DataFrame, _: int) -> None:
        asked = batch.select(F.trim("value").alias("rel_path")).where(F.col("rel_path") != "").dropDuplicates()
        done = detect(not_done(asked, read_done(spark, labels)), make).persist()
        append_labels(done.where(F.col("error").isNull()), labels)
        append_failures(done.where(F.col("error").isNotNull()), failures)
        done.unpersist()

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ema_stream(steps: DataFrame, key: str, order: str, value: str, decay: float, seed: float | None = None) -> DataFrame:
    """key, steps, ema after each batch; state is (steps, ema) per key.

    Rows of a batch are taken in the order of their own type, equal ones by value; rows of a later batch come after
    those of earlier ones.  Keys keep their type.
    """

    def update(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, v = state.get if state.exists else (0, seed)
        rows = pd.concat(list(frames)).sort_values(["order", "value"], kind="stable")
        for x in rows["value"].tolist():
            v = x if v is None else decay * v + (1 - decay) * x
            n += 1
        state.update((n, v))
        yield pd.DataFrame({"key": [group[0]], "steps": [n], "ema": [v]})

    rows = steps.select(F.col(key).alias("key"), F.col(order).alias("order"), F.col(value).cast("double").alias("value"))
    return rows.groupBy("key").applyInPandasWithState(update, f"key {steps.schema[key].dataType.simpleString()}, steps long, ema double", "steps long, ema double", "update", "NoTimeout")


def meter_stream(steps: DataFrame, run: str, step: str, value: str, decay: float, seed: float | None = None) -> DataFrame:
    """run, steps, mean, ema, best, best_step, waiting after each batch, of each run that it touched.

    A run's steps are numbered from 0 and count in that order, however they arrive: a step that comes early waits in
    the state until those before it are there, one that has counted before is left out, as are nulls.  best is
    the largest value so far if it exceeds 0, and best_step its first step.  A restarted query goes on from its checkpoint.
    """

    def update(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total, ema, best, best_step, early = state.get if state.exists else (0, 0.0, seed, None, None, "{}")
        waiting = {int(k): v for k, v in json.loads(early).items()}
        for frame in frames:
            for k, v in zip(frame["step"].tolist(), frame["value"].tolist(), strict=True):
                if k >= n:
                    waiting.setdefault(int(k), v)
        while n in waiting:
            v = waiting.pop(n)
            total += v
            ema = v if ema is None else decay * ema + (1 - decay) * v
            if v > (best or 0.0):
                best, best_step = v, n
            n += 1
        state.update((n, total, ema, best, best_step, json.dumps(waiting)))
        row = {"run": [group[0]], "steps": [n], "mean": [total / n if n else None], "ema": [ema], "best": [best], "best_step": [best_step], "waiting": [len(waiting)]}
        yield pd.DataFrame(row).astype({"best_step": "Int64"})

    rows = steps.select(F.col(run).alias("run"), F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value")).where("step is not null and value is not null")
    schema = f"run {steps.schema[run].dataType.simpleString()}, steps long, mean double, ema double, best double, best_step long, waiting long"
    return rows.groupBy("run").applyInPandasWithState(update, schema, "steps long, total double, ema double, best double, best_step long, early string", "update", "NoTimeout")
