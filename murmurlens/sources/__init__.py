"""Reading raw lines, storing posts and vectors."""
