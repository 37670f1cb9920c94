"""Operators on cell tables (r, c, values) and point tables, as DataFrame plans."""
