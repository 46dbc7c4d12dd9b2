"""Claim analytics as composable Spark DataFrame and Column transformations."""
