"""Named result frames."""
