"""Column helpers: calendar months and the percent-change variants."""
