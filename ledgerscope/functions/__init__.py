"""Column-expression helpers (pure built-ins, stay inside whole-stage codegen)."""
