"""Operators of a training-data pipeline: one module per operator, plus `queries` with the registered queries."""
