"""Each operator bound to the driver's tables, next to the SQL that states its result."""
