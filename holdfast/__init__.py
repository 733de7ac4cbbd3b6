"""holdfast: catalog, holdings and operations analytics as pure DataFrame transformations."""
