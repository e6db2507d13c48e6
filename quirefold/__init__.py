"""quirefold: archives of hypertext documents and full-text search on Spark DataFrames."""
