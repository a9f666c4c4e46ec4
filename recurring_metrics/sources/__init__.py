"""Table schemas, readers and writers, and the adapter for the sample star schema."""
