"""Column functions of cell algebra."""
