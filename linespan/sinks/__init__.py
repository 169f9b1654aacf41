"""Outputs. Summaries have a row for each language and are rendered by the driver; rows of files are streamed."""
