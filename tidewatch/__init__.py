"""tidewatch: telemetry analytics as PySpark DataFrame, Structured Streaming and pyspark.ml jobs."""
