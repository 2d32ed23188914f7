"""Reading page dumps, title lists and trees; writing tables, reports and insert-if-absent collections."""
