"""Lodestone: catalog search, change detection and review over satellite tiles, on Spark."""
