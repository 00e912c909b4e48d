"""Price-index compilation for high-frequency fare quotes, as Spark DataFrame operators.

Every operator is a function from DataFrames to a DataFrame. Nothing here collects
rows, loops over groups on the driver, or launches an action; the only exceptions are
the sinks in ``fareloom.sources`` and the stream starters in ``fareloom.streaming``.
"""

__version__ = "0.1.0"
