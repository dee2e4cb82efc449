"""DataFrame-to-DataFrame operators: rasters, geometry, change, score, models, export."""
