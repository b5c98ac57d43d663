"""Operators of a large-scale training-data pipeline.

Nothing outside this folder imports it. One module holds one operator;
``registry`` holds the queries that apply them to the driver's tables.
"""
