"""Peer-relative, point-in-time scoring on Spark."""
