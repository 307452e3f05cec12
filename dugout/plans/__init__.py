"""Compositions of operators: summaries, the model table, the reports, the model flow."""
