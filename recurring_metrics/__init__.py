"""Subscription-business analytics as PySpark DataFrame operators."""
