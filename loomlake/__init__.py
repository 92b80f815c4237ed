"""loomlake: curation, similarity, splitting and evaluation of labelled collections on Spark."""

__version__ = "0.1.0"
