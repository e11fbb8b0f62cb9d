"""lodestone: repository analytics and training-data operators on PySpark DataFrames."""
