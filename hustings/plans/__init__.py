"""Sessions, the binding of roles to tables, and the registered queries."""
