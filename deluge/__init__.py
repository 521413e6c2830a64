"""deluge: flood-risk analytics on satellite pixel tables, written as Spark jobs.

Layers:
  sources/    scans, fixture adapters and sinks
  functions/  column-level helpers (mask algebra, water indices, dates, geometry)
  operators/  DataFrame operators (collections, composites, neighbourhoods,
              sampling, spatial join, metrics, machine learning)
  plans/      user-level jobs composed from operators, plus the query registry
  streaming/  incremental scoring of newly arriving predictor tiles
"""

__version__ = "0.1.0"
