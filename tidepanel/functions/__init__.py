"""Column functions of panels and their sources."""
