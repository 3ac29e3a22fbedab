"""Feeds of short texts on Spark: sources, cleaning, de-duplication, ranked retrieval and upkeep, as DataFrame plans."""
