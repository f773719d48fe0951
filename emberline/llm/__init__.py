"""Training-text operators over the text fields of observations (and the vectors of grid cells)."""
