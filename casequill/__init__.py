"""casequill: Spark table operators for legal-office documents, files, loans, fees and deadlines.

Every operator is a function from DataFrames to a DataFrame. No operator creates a
session or holds state, and rule sets are arguments with defaults in
``casequill.sources.rules``.
"""

__version__ = "0.1.0"
