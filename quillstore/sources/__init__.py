"""Where tables live: the versioned store and plain files."""
