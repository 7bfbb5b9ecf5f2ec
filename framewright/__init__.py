"""Spark-native analytics for image-sequence captures.

Captures are DataFrames with one row per frame; everything downstream -
measurement, screening, ranking, selection, registration, weighted stacking,
geometry and evaluation - is a DataFrame transformation that Catalyst plans and
Spark distributes.
"""

__version__ = "0.1.0"
