"""Geospatial suitability analytics as Spark jobs: DataFrame in, DataFrame out."""
