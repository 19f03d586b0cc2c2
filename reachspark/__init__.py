"""Reach and frequency analytics on impression logs, written as Spark DataFrame jobs."""
