"""Starloom: analytics over stacks of noisy two-dimensional frames, on Spark."""
