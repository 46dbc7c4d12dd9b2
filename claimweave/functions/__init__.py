"""Column functions and the vocabularies they are generated from."""
