"""Sources of folioloom."""
