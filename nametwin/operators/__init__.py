"""DataFrame-to-DataFrame steps of the matcher."""
