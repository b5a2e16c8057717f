"""Operators for preparing training data, each as a Spark job with its own module."""
