"""Part of evalloom; see the README for the layout."""
