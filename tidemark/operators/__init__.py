"""DataFrame to DataFrame operators, keyed by signal_id."""
