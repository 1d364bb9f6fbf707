"""Operators: functions from DataFrame to DataFrame, lazy unless they say otherwise."""
