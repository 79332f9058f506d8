"""Column expressions: cursors, truthiness and message rendering."""
