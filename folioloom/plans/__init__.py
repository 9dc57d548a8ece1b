"""Plans of folioloom."""
