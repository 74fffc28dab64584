"""PySpark-native retrieval, reranking, calibration and evaluation analytics over text."""
