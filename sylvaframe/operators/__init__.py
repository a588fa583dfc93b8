"""Operators: joins, aggregations, fits, clustering, rasters and metrics on point-cloud DataFrames."""
