"""Column -> Column builders. Everything here stays inside whole-stage codegen."""
