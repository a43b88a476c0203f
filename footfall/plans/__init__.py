"""Reports and batch jobs."""
