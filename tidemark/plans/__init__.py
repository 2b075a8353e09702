"""Jobs that chain operators, and the registered queries with their SQL twins."""
