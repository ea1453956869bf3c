"""Spark batch analytics for spotting unusual invoices in very large transaction tables."""
