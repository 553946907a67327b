"""Where grids come from."""
