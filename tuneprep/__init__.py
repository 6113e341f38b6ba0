"""tuneprep: prepare and score fine-tuning data with PySpark."""

__version__ = "0.1.0"
