"""Operators: functions from DataFrame to DataFrame, and the kernels they run."""
