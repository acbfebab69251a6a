"""Named queries with their SQL twins, and the stage drivers."""
