"""Catalogue of large collections of model files, as Spark DataFrame jobs."""

# Version of the rule that turns name, architecture and parameters into a family key.
FAMILY_KEY_ALGO = "1"
# Version of the table layout in `shelfmark.schemas`.
SCHEMA_VERSION = "1"
