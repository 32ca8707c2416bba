"""plotline: land-parcel raster and vector analytics as Spark jobs."""
