"""Array, signal and image analytics as Spark DataFrame plans."""
