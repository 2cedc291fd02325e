"""Jobs that chain operators, write tables, validate them, and publish the result."""
