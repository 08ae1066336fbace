"""Ready-made queries over the star-schema tables and their SQL twins."""
