"""velomart: bike-share hire analytics written as Spark DataFrame plans.

Layout
------
functions   reusable ``Column`` expressions (keys, labels, time arithmetic)
operators   reusable ``DataFrame`` operators (median, latest row, checks, reshape)
sources     scans, source registry, catalog access, test-data adapters
sinks       table writes: staged, replaced, partitioned, copied
plans       the warehouse models and the analytical queries
registry    the named queries and their SQL twins
"""
