"""Rubric scoring and ordinal evaluation over nested program documents, on Spark SQL."""
