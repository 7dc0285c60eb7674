"""Image-provenance analytics as PySpark DataFrame and Structured Streaming operators."""
