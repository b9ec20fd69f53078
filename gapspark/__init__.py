"""Critic/audience gap analytics as Spark jobs.

Every operator is a function from DataFrames to a DataFrame that answers for the
whole catalogue at once; a caller who wants one film filters the result.
"""

__version__ = "0.1.0"
