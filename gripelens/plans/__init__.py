"""The end-to-end run, the fixture views and the query catalogue."""
