"""Analytics over large collections of notes and the records extracted from them, on Spark DataFrames."""
