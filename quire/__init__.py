"""quire: knowledge-base analytics as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame.
"""
