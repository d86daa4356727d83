"""Part of gramforge."""
