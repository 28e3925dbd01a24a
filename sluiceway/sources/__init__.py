"""Where rows come from: tables, queries, text tables, databases."""
