"""Job-posting analytics and matching on Spark DataFrames."""
