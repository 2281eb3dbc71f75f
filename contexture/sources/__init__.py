"""Where data comes from and where it goes."""
