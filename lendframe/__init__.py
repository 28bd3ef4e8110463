"""lendframe: credit-risk scorecard analytics as lazily evaluated Spark DataFrames."""
