"""lexaria: text analytics, retrieval and link analysis on Spark DataFrames."""
