"""Reading and writing result documents, annotation text and lookup tables."""
