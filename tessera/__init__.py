"""tessera: text features and run-scaling analytics as plain Spark DataFrame plans.

Layout
------
functions/  Column -> Column expressions (article features, numeric guards, labels)
operators/  DataFrame -> DataFrame operators (shaping, stage metrics, scaling, validation)
sources/    readers / writers (CSV articles, run-record files) and the test-data fixtures
plans/      composed pipelines (feature extraction) and the registered query catalogue
streaming/  the same stateless feature plan on a Structured Streaming source
"""

__version__ = "0.1.0"
