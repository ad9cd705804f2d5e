"""Cross-venue market analytics as PySpark DataFrame operators."""
