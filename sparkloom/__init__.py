"""Spark-native event normalisation, lineage, publication and data quality."""
