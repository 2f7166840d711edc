"""Identity-document field extraction as Spark DataFrame jobs."""
