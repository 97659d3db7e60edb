"""Part of lotwright."""
