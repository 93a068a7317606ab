"""Column functions; all run inside whole-stage codegen unless the docstring says otherwise."""
