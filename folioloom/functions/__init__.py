"""Functions of folioloom."""
