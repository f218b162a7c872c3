"""Time-series anomaly detection with language models, as Spark plans.

Every step works on long tables keyed by signal, window and sample, so that
thousands of signals run in one plan; see README.md for the map of modules.
"""
