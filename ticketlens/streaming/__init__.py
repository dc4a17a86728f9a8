"""Stateless jobs that also run on a stream."""
