"""Spark jobs over the session logs of AI coding agents."""
