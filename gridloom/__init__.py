"""gridloom: table reconstruction from positioned text, on Spark DataFrames."""
