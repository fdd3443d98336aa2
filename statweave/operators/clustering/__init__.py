"""Clustering of points: canopy, seeded k-means, projected clustering, Dirichlet mixtures, validation.

Points are a DataFrame with ``point`` array<double> (other columns are carried
along where noted).  Models are small and live on the driver; what grows with
the data stays distributed.
"""
