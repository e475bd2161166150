"""fieldloom: batch and streaming Spark jobs for geospatial, raster, detection and text data."""
