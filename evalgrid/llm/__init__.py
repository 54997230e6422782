"""Operators of a training-data pipeline: ten operators, each in its own module.

Every operator takes DataFrames whose columns are named by parameters, reads
only those columns, and returns new columns or tables. The registered queries
are in ``queries``; nothing outside this package imports it.
"""
