"""leadlens: lead-to-revenue analytics as Spark DataFrame jobs."""
