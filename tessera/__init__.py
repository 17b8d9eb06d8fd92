"""Analytics on document collections as Spark DataFrame plans."""
