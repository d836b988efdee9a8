"""Reading packets of source files."""
