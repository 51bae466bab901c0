"""jobatlas: job-posting ingestion and office-map analytics as Spark DataFrame plans.

Sub-packages
------------
functions  Column -> Column expressions (text cleaning, classification, geo math, display labels)
sources    feed payload adapters, table readers, sinks
operators  DataFrame -> DataFrame operators (normalise, dedup, geocode, merge, pins, facets, clustering, checks)
plans      end-to-end batch plans (an ingestion run with its metrics) and the registered query catalogue
streaming  Structured Streaming versions of the incremental load and facets
"""

__all__ = ["functions", "sources", "operators", "plans", "streaming"]
