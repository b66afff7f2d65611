"""textlab: text-classification analytics as Spark DataFrame operators."""
