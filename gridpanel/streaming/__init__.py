"""The stateless cleaning steps applied to arriving files."""
