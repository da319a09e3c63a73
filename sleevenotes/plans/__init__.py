"""Plan tables: what would be renamed, moved, merged or undone."""
