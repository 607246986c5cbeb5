"""Column functions and the fixed tables that they rest on."""
