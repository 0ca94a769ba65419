"""A PySpark engine that collects, normalizes, merges and serves event listings, and prepares text corpora."""
