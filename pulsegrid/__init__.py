"""Condition-monitoring analytics as ordinary PySpark DataFrame operators."""
