"""Incremental loading of a drop folder."""
