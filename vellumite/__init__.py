"""A PySpark library for inspecting, cleaning and shrinking large collections of PDF documents."""
