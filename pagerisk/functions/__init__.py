"""Functions of the page-risk engine."""
