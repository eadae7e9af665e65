"""Functions of pagewarden."""
