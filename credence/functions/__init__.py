"""Part of credence."""
