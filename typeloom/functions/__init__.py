"""Column expressions: logical types' coercions and checks, and datetime formats."""
