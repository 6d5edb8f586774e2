"""Column functions: expressions that stay within code generation."""
