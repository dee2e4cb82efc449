"""Urban change analytics as Spark jobs: composites, change maps, zones, scores, models."""
