"""DataFrame operators, free of any particular job."""
