"""A PySpark-native analytics engine for molecular-barcode sequencing data."""
