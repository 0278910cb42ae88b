"""quillon: a PySpark-native analytics engine for exam-preparation data."""
