"""ledgerloom: a PySpark-native engine for decision records, disclosure tables and text corpora."""
