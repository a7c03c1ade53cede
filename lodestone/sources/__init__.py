"""Sources: raw pages, event streams and wire tables as rows."""
