"""Text parsing and tree queries on Spark: tokens, sentences, parse trees and their relational queries."""

__version__ = "0.1.0"
