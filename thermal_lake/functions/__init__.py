"""Column-level helpers: missing values, text formats, identities, geometry, colour, numerics."""
