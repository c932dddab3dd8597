"""Record quality, audit and reconciliation operators as PySpark DataFrame functions."""
