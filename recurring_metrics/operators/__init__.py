"""DataFrame-to-DataFrame operators of the revenue model."""
