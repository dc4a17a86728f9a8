"""The analytical jobs: cleaning, enrichment, views, reports, extracts, models."""
