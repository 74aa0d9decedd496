"""Planning and context-assembly jobs."""
