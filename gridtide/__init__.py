"""Metered time-series analytics as lazy Spark DataFrame functions."""
