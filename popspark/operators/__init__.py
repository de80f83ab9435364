"""Operators on tables of intervals, sites, maps and windows."""
