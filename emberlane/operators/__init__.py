"""DataFrame operators: meters, daily rollups, fits, attribution, quality."""
