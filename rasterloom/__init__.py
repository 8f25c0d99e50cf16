"""A PySpark-native engine for compressed raster media as tables."""
