"""Independent SQL for the results of the registered queries."""
