"""CRM data quality, deduplication and repair on Spark DataFrames."""
