"""Analytics for machine-in-the-loop writing, expressed as Spark jobs."""
