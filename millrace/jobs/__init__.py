"""Small programs for ``spark-submit``."""
