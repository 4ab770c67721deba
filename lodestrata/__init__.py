"""lodestrata: a PySpark-native engine for labelled source-code and text corpora."""
