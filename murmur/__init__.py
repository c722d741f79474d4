"""Analytics over timed, scored events, on Spark DataFrames."""
