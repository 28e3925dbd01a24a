"""Column builders: text rules, type names, name search, per-topic helpers."""
