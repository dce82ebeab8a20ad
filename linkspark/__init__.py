"""linkspark: crawl analytics as PySpark DataFrame jobs and streaming queries."""
