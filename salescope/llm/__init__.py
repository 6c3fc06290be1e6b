"""Operators of a large-scale training-data pipeline.

One module per operator; ``queries`` registers them.  Nothing outside this folder (and the
pipeline script that belongs to it) imports it, so it can be removed as a whole.
"""
