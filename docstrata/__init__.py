"""Profiling of semi-structured data with Spark."""
