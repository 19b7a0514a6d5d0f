"""Reading irregular files as distributed jobs, and publishing checked snapshots."""
