"""Streaming runners."""
