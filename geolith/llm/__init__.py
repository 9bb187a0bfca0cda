"""Training-data operators; nothing else in geolith imports this subpackage."""
