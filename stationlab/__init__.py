"""Station time-series analytics on Spark DataFrames.

Every operator takes and returns DataFrames (or Columns) and stays lazy unless
its docstring says otherwise.  See README.md for the map of modules.
"""
