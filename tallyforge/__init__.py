"""A PySpark engine for security reference data and for training-data pipelines."""
