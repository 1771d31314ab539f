"""Operators for preparing training text at scale, each a Spark job over a table of documents, pages or turns."""
