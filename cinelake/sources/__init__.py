"""Reading media folders and catalog tables, and writing tables and documents."""
