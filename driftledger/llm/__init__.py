"""Training-data operators on Spark.

Nothing else in the library imports this subpackage.  Every operator module
takes and returns DataFrames and selects the columns it needs by name, so extra
columns of the input never clash with the ones it adds.
"""
