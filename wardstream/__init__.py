"""Spark jobs that screen, replay and report on recorded chat traffic."""

__version__ = "0.1.0"
