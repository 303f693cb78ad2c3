"""Document analytics on Spark: corpus audit, version comparison and page accounting as DataFrame plans."""
