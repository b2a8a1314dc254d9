"""A document-intelligence analytics engine on Spark."""
