"""Record linkage and corpus preparation on PySpark."""
