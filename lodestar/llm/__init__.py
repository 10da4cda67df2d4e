"""Training-data operators: deduplication, scoring, packing, archives, media and token counts.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
