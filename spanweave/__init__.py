"""Spark-first analytics over evidence-backed, time-valid property graphs."""
