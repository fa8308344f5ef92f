"""Column functions shared by operators."""
