"""Training-data operators: ten text and vector operators that run on Spark.

Nothing else in the library imports this subpackage.
"""
