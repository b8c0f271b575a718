"""Planning: which branches, paths and repositories to work on."""
