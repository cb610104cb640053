"""Reading tables and writing reports, clean rows and quarantined rows."""
