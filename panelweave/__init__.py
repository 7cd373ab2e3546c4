"""Entity-week text analytics on Spark DataFrames.

Every operator is a plain function on DataFrames or Columns. Column names
are parameters, plans stay lazy unless a docstring says otherwise, and only
results with a fixed size bound (k x k matrices, cut points, model
summaries) reach the driver.
"""

__version__ = "0.1.0"
