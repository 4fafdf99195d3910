"""Task grids, chunks, and what is left to do."""
