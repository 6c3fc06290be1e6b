"""salescope.plans."""
