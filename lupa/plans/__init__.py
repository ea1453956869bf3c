"""Whole jobs, Parquet to Parquet, assembled from the operators."""
