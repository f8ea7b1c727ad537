"""A Spark-first engine for geographic statistics, record-level lending data and their preparation."""
