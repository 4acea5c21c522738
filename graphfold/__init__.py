"""graphfold: a PySpark-native graph and text retrieval engine."""
