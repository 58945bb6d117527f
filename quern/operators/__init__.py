"""Operators composed of DataFrame functions."""
