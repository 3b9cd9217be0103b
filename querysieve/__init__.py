"""querysieve: build, clean and analyse large SQL query logs on Spark and find the unusual statements."""

__version__ = "0.1.0"
