"""tidegrid: spatiotemporal graph analytics as lazy, composable PySpark DataFrame functions."""
