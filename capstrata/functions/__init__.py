"""Part of capstrata."""
