"""Compositions of operators: report sets, rollups, bulk loads and publishing."""
