"""DataFrame operators over a relational model."""
