"""scriptorium: a PySpark-native engine for searching and relating project text."""
