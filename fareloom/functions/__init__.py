"""Column-level helpers: rounding, text codes, dates and literal lookups."""
