"""Where files and vocabularies come from."""
