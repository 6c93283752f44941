"""tidemark: point-in-time analytics for market-style time series on Spark.

Every public operator maps DataFrames to a DataFrame and stays lazy, so a
chain of operators is one Catalyst plan.
"""
__version__ = "0.1.0"
