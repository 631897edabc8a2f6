"""Graph containers, cleaning steps and base tables."""
