"""Training-data operators over the corpus tables; nothing else in the library imports this subpackage."""
