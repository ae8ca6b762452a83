"""Document analytics expressed as Spark DataFrame transformations."""
