"""Partita: open-set entity resolution and partition refinement on Spark DataFrames."""
