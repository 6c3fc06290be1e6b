"""salescope.operators."""
