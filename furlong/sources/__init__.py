"""Entry tables in, dataset versions and results out."""
