"""Marketplace order analytics as Spark DataFrame operators."""
