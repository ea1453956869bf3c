"""Feature preparation, isolation forest, surrogate tree and evaluation."""
