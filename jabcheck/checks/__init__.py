"""Every operator as a query over stand-in tables, beside SQL that must give the same rows."""
