"""From what a file imports to the file that is meant."""
