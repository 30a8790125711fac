"""Readers and writers for flow tables, reports, parameters and trials."""
