"""Composed results: monthly summary, dashboard views, forecasts, ad-hoc SQL, refresh."""
