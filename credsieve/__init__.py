"""Credential-leak scanning and dataset-quality analytics on PySpark DataFrames."""
