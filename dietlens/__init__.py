"""dietlens: mining short advice texts and answering questions against them, on Spark DataFrames."""

__version__ = "0.1.0"
