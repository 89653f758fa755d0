"""readprep: a PySpark-native engine for sequencing reads and the studies built from them."""
