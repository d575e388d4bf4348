"""tidemark: Spark-native time-series panel analytics.

Profiling, window features, feature selection, regression / GLM / tree
models with expanding time-ordered validation, and keyed scenario scoring,
all expressed as Spark DataFrame plans.
"""

__version__ = "0.1.0"
