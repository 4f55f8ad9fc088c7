"""adloom: harvest, deduplicate and classify listings with Spark DataFrames."""

__version__ = "0.1.0"
