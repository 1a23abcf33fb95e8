"""Analytics over agent memory, built on Spark DataFrames."""
