"""Pipelines, model stages, the detector front and the benchmark harness."""
