"""Service-desk and SLA analytics expressed as PySpark DataFrame jobs."""
