"""Pitch-event analytics on Spark: clean, flag, aggregate, reshape, model, report."""
