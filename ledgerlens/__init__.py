"""A PySpark-native data-intelligence engine.

Loads typed tables from declared sources, keeps a versioned catalog of what those tables mean, and computes and
stores analytical evidence about them as DataFrame and Spark SQL plans.
"""

__version__ = "0.1.0"
