"""eventflow: event-pipeline and change-data operators on Spark DataFrames."""
