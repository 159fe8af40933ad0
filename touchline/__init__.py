"""touchline: point-in-time match analytics as Spark jobs."""
