"""The ten crash analyses, the job that runs them, and the query catalogue."""
