"""matchloom: record matching and corpus preparation as Spark DataFrame operators."""

__version__ = "0.1.0"
