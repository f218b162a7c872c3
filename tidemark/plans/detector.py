"""The front: a pipeline by name, detect() over all signals of a table at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pipeline import Pipeline, resolve


class Detector:
    """interval, decimal and window_size go to whichever stage of the pipeline takes them; 0 is a value."""

    def __init__(self, pipeline: str | dict, interval: int | None = None, decimal: int | None = None, window_size: int | None = None, hyperparameters: dict | None = None):
        self.spec = resolve(pipeline)
        params = {k: dict(v) for k, v in (hyperparameters or {}).items()}
        for value, key, names in ((interval, "interval", ("time_segments_aggregate", "normal_as_string")), (decimal, "decimal", ("float2scalar", "normal_as_string")), (window_size, "window_size", ("rolling_window_sequences",))):
            for name in names if value is not None else ():
                if name in self.spec["stages"]:
                    params.setdefault(f"{name}#1", {})[key] = value
        self.hyperparameters = params

    def detect(self, df: DataFrame, normal: DataFrame | None = None, visualization: bool = False, on_error: str = "raise", **clients):
        """(signal_id, start, end, severity); with visualization also the context of named tables.

        on_error: raise, or keep, which leaves out signals of which a prompt has no
        answer; the context then has failed (signal_id, error) and seconds. The plan
        writes tables on the way, which stand until the process ends: consume the
        result within tables.scope(), or call tables.release().
        """
        p = Pipeline.load(self.spec, self.hyperparameters)
        for name, client in clients.items():
            p.spec["params"].setdefault(f"{name}#1", {})["client"] = client
        inputs = {"signals": as_signals(df), "on_error": on_error} | ({} if normal is None else {"normal": as_signals(normal)})
        c = p.run(**inputs)
        out = c["anomalies"].select("signal_id", "start", "end", "severity")
        return (out, c) if visualization else out


def as_signals(df: DataFrame) -> DataFrame:
    """A (timestamp, value) frame is one signal; long tables pass."""
    if {"signal_id", "ts", "dim", "value"} <= set(df.columns):
        return df.select("signal_id", "ts", "dim", "value")
    if {"timestamp", "value"} <= set(df.columns):
        return df.select(F.lit("signal").alias("signal_id"), F.col("timestamp").cast("bigint").alias("ts"), F.lit(0).alias("dim"), F.col("value").cast("double").alias("value"))
    raise ValueError("expected (signal_id, ts, dim, value) or (timestamp, value)")
