"""Time-series analytics and forecasting on keyed, ordered Spark DataFrames."""

__version__ = "0.1.0"
