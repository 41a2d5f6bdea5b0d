"""Functions of the library; see the modules."""
