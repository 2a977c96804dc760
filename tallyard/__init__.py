"""tallyard: a PySpark-native engine for auditing judgments about texts and for preparing training data."""
