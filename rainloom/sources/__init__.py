"""Readers and writers for station exports, grids, counters, result files and tables."""
