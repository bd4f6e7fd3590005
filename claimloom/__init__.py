"""claimloom: a PySpark-native engine for evidence-linked claim graphs."""
