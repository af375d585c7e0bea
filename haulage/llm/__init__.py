"""Operators for preparing training text: sharding, deduplication, extraction, scoring, mixing and packing.

Nothing outside this subpackage imports it. Every operator takes and returns DataFrames, reads its input
only through Spark, and writes what it must keep between jobs to the folder named by ``spark.checkpoint.dir``.
"""
