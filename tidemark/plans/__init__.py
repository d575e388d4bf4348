"""Composed plans: the query catalog, configured pipelines, training flow."""
