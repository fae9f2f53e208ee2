"""Training-data operators. Nothing else in captionforge imports this subpackage."""
