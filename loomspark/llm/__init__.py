"""Training-data pipeline operators.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and returns DataFrames; ``queries`` holds the thin production queries.
"""
