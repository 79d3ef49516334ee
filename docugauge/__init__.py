"""Docugauge: document-conformity checks and measurement analytics as Spark DataFrame operators."""
