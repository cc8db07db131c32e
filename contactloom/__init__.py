"""Chromosome contact-map analytics as Spark jobs."""
