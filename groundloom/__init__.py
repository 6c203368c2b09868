"""Site-scan analytics on Spark: points, splats, cameras, rasters, meshes and logs as tables."""
