"""lemmata: Spark-native retrieval, cleaning and verification of short technical documents."""

__version__ = "0.1.0"
