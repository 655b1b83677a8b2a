"""Contract-change impact, ranking, routing and audit operators on Spark DataFrames."""
