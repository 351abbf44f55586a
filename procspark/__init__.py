"""Process mining and control conformance as Spark DataFrame plans."""
