"""Event analytics on Spark: one wide table of JSON events, many small operators.

Every operator is a function from DataFrames to a DataFrame; see the modules
under ``operators`` (batch), ``streaming`` (Structured Streaming) and
``sources`` (reading, writing and table upkeep).
"""
