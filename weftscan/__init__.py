"""Spark-native source-text segmentation: tables of program source in, tables of tagged text segments out."""

__version__ = "0.1.0"
