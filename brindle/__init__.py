"""brindle: a Spark-first dataset builder, small warehouse and query layer."""

__version__ = "0.1.0"
