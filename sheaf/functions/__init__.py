"""Part of the sheaf package."""
