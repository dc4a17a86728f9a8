"""Independent SQL statements of the results, for the side-by-side check."""
