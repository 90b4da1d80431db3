"""A PySpark-native analytics engine for legal and parliamentary text corpora."""
