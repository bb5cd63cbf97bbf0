"""tickflow: telemetry analytics for message streams and host samples on Spark.

Sub-packages:

* ``sources``   readers, sinks and the projections of the driver tables (fixtures)
* ``functions`` Column-level scalar functions and rule chains
* ``operators`` DataFrame operators: windows, ticks, alignment, statistics, reports
* ``plans``     composed queries (the registry behind ``__spark_entry__``) and their SQL oracles
* ``streaming`` Structured Streaming counterparts of the live metrics
"""

__version__ = "0.1.0"
