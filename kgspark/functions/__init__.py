"""Column functions over names, titles, dates and IRIs, and the wikitext helper."""
