"""Named queries, views and end-to-end jobs."""
