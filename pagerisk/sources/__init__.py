"""Sources of the page-risk engine."""
