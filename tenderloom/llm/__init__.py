"""Training-data operators: ten stages of a corpus pipeline on Spark.

Nothing outside this folder imports it. Every operator takes and returns
DataFrames; ``queries.py`` binds them to the synthetic tables.
"""
