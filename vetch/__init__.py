"""vetch: checking work deliverables, and preparing training text, as Spark jobs."""
