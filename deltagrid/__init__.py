"""Spark-first geospatial analytics: an icosahedral grid and the operators of a map data pipeline."""
