"""Spark DataFrame operators for scoring risk in a table of timed transactions."""
