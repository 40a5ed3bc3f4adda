"""pagemill: crawled web pages to a clean article table, as Spark DataFrame jobs."""
