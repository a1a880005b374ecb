"""Key-ordered analytics on Spark: versioned change logs, ordered scans, secondary indexes and sketches."""
