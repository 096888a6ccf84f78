"""Spatial and sensor analytics as composable DataFrame operators."""
