"""helixmill: a PySpark-native engine for sequencing-read datasets."""
