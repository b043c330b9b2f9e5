"""Point-in-time forecast evaluation and training-data operators on PySpark."""
