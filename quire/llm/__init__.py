"""Operators of a training-data pipeline, one module each; see ``registry`` for their queries."""
