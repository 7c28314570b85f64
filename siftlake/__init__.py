"""Siftlake: credential analytics over text tables, written as Spark DataFrame jobs."""
