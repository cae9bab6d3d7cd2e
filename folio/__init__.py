"""folio: document analytics on Apache Spark, declared with the DataFrame and SQL API."""

__version__ = "0.1.0"
