"""Plans over several steps: pipelines and protection levels."""
