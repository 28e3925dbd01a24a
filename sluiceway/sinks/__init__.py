"""Where rows go: files, catalog tables, databases, or nowhere (dry run)."""
