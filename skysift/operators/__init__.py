"""DataFrame operators on pixel, tile, run and region tables."""
