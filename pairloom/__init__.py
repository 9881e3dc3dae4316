"""pairloom: a Spark-first engine for comparing two versions of a language-model system."""

__version__ = "0.1.0"
