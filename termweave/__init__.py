"""Terminology mapping on Spark: load local codes, map them onto a target system, query the result."""
