"""helixframe: variant annotation, evidence rules and cohort evaluation on Spark.

Every public operator is a function ``(DataFrame, **params) -> DataFrame`` or a
``Column`` builder, so jobs compose with ordinary PySpark code.
"""

__version__ = "0.1.0"
