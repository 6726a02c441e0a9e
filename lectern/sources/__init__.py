"""Sources: document archives, compound files and equation objects."""
