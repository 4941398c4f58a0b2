"""Pages drawn on NumPy bitmaps, inside a task: the page-local twin of the relational operators."""
