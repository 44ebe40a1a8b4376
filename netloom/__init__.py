"""Web-page corpus analytics on Spark DataFrames."""
