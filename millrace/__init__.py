"""Millrace: retrieval, calibration, evaluation and training-data operators as Spark DataFrame programs."""
