"""Operators of a training-data pipeline, each a DataFrame -> DataFrame job.

Nothing outside this folder imports it.
"""
