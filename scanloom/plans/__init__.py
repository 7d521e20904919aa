"""Named queries over the test tables, and their SQL where SQL can express them."""
