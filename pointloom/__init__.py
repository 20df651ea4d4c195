"""pointloom: point-cloud segmentation and related analytics as PySpark DataFrame plans."""
