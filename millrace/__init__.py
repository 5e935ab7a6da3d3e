"""Spark jobs for table and stream applications, spend, rates, objects and chat requests."""
