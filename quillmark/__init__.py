"""Evidence-annotation analytics on Spark."""
