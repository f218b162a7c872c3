"""One formatter from end to end, for trying encodings out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import encode, parse
from ..operators import forecast, prep
from .pipeline import Pipeline

#: Values that an answer may have besides those asked for, in steps of all dimensions.
SPARE = 1


def run_pipeline(signals: DataFrame, method: str, strategy: str = "scaling", num_dims: int = 1, target_column: int = 0, window_size: int = 15, steps: int = 1, client=None, samples: int = 1, normalize: bool = False, stride: int = 1, steps_ahead: list[int] | None = None, **params) -> DataFrame:
    """Errors (signal_id, position, ts, y, y_hat, error) of a formatter, rounded to 7 places.

    normalize puts z-scores in the place of the values first. With steps_ahead, the
    windows lie stride apart and each gives (signal_id, win, step, y_hat, y, error) for
    every step asked for: the median over its samples, not joined to other windows'.
    """
    if strategy != "scaling":
        raise ValueError(f"strategy {strategy!r}: only scaling is offered")
    if method not in encode.ENCODERS:
        raise ValueError(f"unknown method {method!r}")
    if steps_ahead and method not in ("json_format", "persistence_control"):
        raise ValueError(f"{method!r} has no answers for several steps")
    signals = prep.normalize(signals) if normalize else signals
    most = max(steps_ahead) if steps_ahead else steps
    stages = ["time_segments_aggregate", "impute", "float2scalar", "rolling_window_sequences", "format_as_string", "forecast_model", "format_as_integer", "scalar2float", "aggregate_rolling_window", "regression_errors"]
    given = {
        "rolling_window_sequences#1": {"window_size": window_size, "target_size": most if steps_ahead else 1, "step_size": stride if steps_ahead else 1, "target_column": target_column},
        "format_as_string#1": {"encoder": method, "target_column": target_column},
        "forecast_model#1": {"client": client, "samples": samples, "steps": most * (num_dims + SPARE)},
        "format_as_integer#1": {"trunc": 1, "num_dims": num_dims, "target_column": 0 if method.endswith("control") else target_column},
    }
    p = Pipeline.load({"stages": stages, "params": given}, params)
    if not steps_ahead:
        return p.run(signals=signals)["errors"].withColumn("error", F.round(F.col("y") - F.col("y_hat"), 7))
    c = p.run(0, 5, signals=signals)
    if method == "json_format":
        by_step = parse.json_steps(F.col("response"), steps_ahead, target_column)
    else:
        by_step = F.create_map(*[x for s in steps_ahead for x in (F.lit(s), parse.last_value(F.col("response")))])
    low = c["scaled"].select("signal_id", "minimum").distinct()
    said = c["responses"].select("signal_id", "win", "first_index", "sample", F.explode(by_step).alias("step", "x")).join(low, "signal_id")
    said = said.withColumn("y_hat", prep.scalar_to_float(F.col("x").cast("double"), F.col("minimum"), c["decimal"]))
    at = c["scaled"].filter(F.col("dim") == target_column).select("signal_id", "idx", F.col("value").alias("y"))
    steps_of = said.select("signal_id", "win", "step", (F.col("first_index") + window_size + F.col("step") - 1).alias("idx")).distinct()
    return forecast.multistep_errors(said, steps_of.join(at, ["signal_id", "idx"]).select("signal_id", "win", "step", "y"))
