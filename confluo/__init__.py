"""Structural merging, matching and review of many documents, as Spark jobs."""
