"""Road-crash analytics expressed as Spark DataFrame plans."""
