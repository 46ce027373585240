"""A PySpark-native engine for keyed event pipelines over lakehouse tables."""
