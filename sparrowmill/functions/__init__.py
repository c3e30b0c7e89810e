"""Part of sparrowmill."""
