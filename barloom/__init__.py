"""barloom: daily price-bar analytics expressed as Spark DataFrame jobs."""
