"""Complete jobs and the registered queries."""
