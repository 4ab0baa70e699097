"""Interval-event analytics on Spark: DataFrame-to-DataFrame operators, no global session."""
