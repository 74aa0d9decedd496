"""Jobs over the domain tables."""
