"""Jobs composed from the operators: import, merge, export, reports."""
