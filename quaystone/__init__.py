"""Analytics over public-service open data and training-data preparation, on PySpark."""
