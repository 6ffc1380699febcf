"""Ordered, hierarchical and text analytics on Spark."""
