"""Travel-plan and shopping-list analytics as Spark DataFrame transformations."""
