"""Job-listings analytics on Spark: pages and JSON in, clean offer tables and reports out."""
