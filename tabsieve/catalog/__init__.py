"""Query registrations, one module per area."""
