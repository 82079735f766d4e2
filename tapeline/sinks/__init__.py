"""Writers: Markdown files named by row, log tables, discarding."""
