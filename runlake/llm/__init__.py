"""Operators of a training-data pipeline.

One module per operator; :mod:`runlake.llm.queries` registers the queries.  Nothing outside
this package imports it.
"""
