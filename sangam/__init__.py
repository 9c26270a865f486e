"""Sangam: code-switched text analytics as PySpark DataFrame operators."""
