"""Training-data operators on texts and code.  Nothing else in the library imports this subpackage."""
