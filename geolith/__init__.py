"""geolith: located-event analytics as ordinary Spark DataFrame operators."""
