"""storyline: PySpark-native analytics for long-form text and script production data."""

__version__ = "0.1.0"
