"""Reading and writing tables, predictions, decisions and fitted runs."""
