"""Interval-stream analytics as lazy Spark DataFrame operators."""
