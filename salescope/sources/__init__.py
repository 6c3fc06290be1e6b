"""salescope.sources."""
