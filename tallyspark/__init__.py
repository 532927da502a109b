"""tallyspark: financial reconciliation and corpus preparation as PySpark jobs."""
