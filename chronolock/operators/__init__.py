"""Operators: functions of DataFrames, without actions inside unless they say so."""
