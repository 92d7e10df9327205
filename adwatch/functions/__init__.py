"""Column builders: every function takes and returns :class:`pyspark.sql.Column`."""
