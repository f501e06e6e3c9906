"""Document-layout analytics expressed as Spark DataFrame operators."""
