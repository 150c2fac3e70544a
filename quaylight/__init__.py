"""quaylight: a PySpark-native analytics engine for payment-risk data."""
