"""Shaping rows for stores and queues, and writing them."""
