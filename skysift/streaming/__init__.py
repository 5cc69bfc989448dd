"""Scenes that arrive over time, with the batch operators."""
