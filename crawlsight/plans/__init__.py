"""Whole jobs and SQL views put together from the operators."""
