"""The data model and the registered queries."""
