"""Reading and writing tables with their typing information."""
