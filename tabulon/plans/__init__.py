"""Query specifications and guarded SQL."""
