"""Accessibility and network analytics over long origin-destination tables, built on the Spark DataFrame API."""
