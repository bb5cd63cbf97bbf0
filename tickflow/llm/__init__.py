"""Training-data operators: one module per operator, `queries` registers one query for each.

Nothing outside this folder imports it; on a cluster the package has to be importable by the
executors' Python (installed there, or given with ``--py-files``)."""
