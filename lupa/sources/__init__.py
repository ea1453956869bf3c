"""Catalog and Parquet inputs, Parquet outputs, and the test-data views."""
