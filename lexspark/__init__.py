"""lexspark: norm-document analytics and training-data operators on Spark DataFrames."""
