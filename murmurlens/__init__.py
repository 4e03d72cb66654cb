"""murmurlens: narrative analytics for social-media posts, written as Spark DataFrame jobs."""

__version__ = "0.1.0"
