"""Lectern: Spark operators for large collections of time-coded and paged sources.

Every public operator is a plain function from DataFrames to a DataFrame. Tables
are keyed by ``source_id`` (or ``job_id``) and list order is an explicit ``seq``
column, so any operator can be planned, partitioned and retried by Spark.
"""
