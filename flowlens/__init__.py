"""flowlens: network-flow intrusion analytics expressed as Spark jobs.

Everything here takes and returns DataFrames (or Columns); Catalyst decides how
the work runs. The sub-packages are

``functions``  column expressions (no jobs, no state)
``operators``  DataFrame transformations: cleaning, labels, features, metrics, alerts
``sources``    readers, writers and the shared folder used to cut lineage
``streaming``  Structured Streaming detection and its sinks
``plans``      whole pipelines and the registered query catalogue
"""

__version__ = "0.1.0"
