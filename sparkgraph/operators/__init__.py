"""Typed patterns as DataFrames: scans, joins, anti-joins, inline rows and solution modifiers."""
