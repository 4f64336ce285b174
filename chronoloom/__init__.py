"""Time-series preparation, cleaning, forecasting evaluation and profiling on Spark.

Every public function maps DataFrames to DataFrames and takes its session from
its inputs; nothing here keeps a global session.
"""

__version__ = "0.1.0"
